"""From raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; ``run`` applies them to the table of documents. Its rows have no SQL
form (a fitted classifier, a tokenizer), so a test holds all of it against plain
versions of its stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import stages
from sparkloom.llm.common import discard, stored, table

STAGES = [
    ("quality classifier", stages.good_documents),
    ("line dedup", stages.without_recurring_lines),
    ("MinHash near-dedup", stages.one_of_near_duplicates),
    ("suffix-array dedup", stages.without_repeats),
    ("packing", stages.packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what one returns is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), keep=name.split()[0].lower())
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
