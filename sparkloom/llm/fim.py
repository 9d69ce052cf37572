"""Fill-in-middle transformation by repeated-capture matching.

One full match of ``(unit)*`` by the ``regex`` library keeps every repetition of its
group: ``match.ends(1)`` holds where each unit of the text ends, so its length is
the number of units and two of its entries are the cuts. A document's draws come
from the SHA-256 of its id alone, so a retried task or another partitioning gives
the same rows. There is no shuffle.

A text of more than ``WINDOW`` units is matched in windows of so many units, end to
end, since the library keeps all captures of a match in memory; only a window's
captures are there at once. Units are taken greedily, left to right, without going
back, so the windows' captures are those of the one match.

Defined results: a null text is the empty text, whose form is plain. A null doc_id
draws as an empty one. Repeated rows are transformed each. A text that holds one of
the three markers stays plain, so an output can always be undone. Extra columns are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, column

PREFIX, SUFFIX, MIDDLE = MARKERS = ("<P>", "<S>", "<M>")
#: A code point.
UNIT = r"(?s:.)"
#: Units whose captures are held at once.
WINDOW = 1 << 18
#: Of 100 draws: those that transform, and of these, those of the form spm.
RATE, SPM = 90, 20
RESULT = "doc_id long, n long, form string, prefix_units long, middle_units long, prefix_chars long, middle_chars long, output string"


class Units:
    """Where the units of a text end."""

    def __init__(self, text: str, unit: str = UNIT, window: int = WINDOW):
        self._text = text
        self._whole, self._part = regex.compile(f"(?:({unit}))*+"), regex.compile(f"(?:({unit})){{1,{window}}}+")
        self._starts: list[tuple[int, int]] = []  # units and characters before each window
        self.n = 0
        if len(text) <= window:
            match = self._whole.fullmatch(text)
            self._ends = self._checked(match).ends(1)
            self.n = len(self._ends)
            return
        at = 0
        while at < len(text):
            match = self._checked(self._part.match(text, at))
            self._starts.append((self.n, at))
            self.n, at = self.n + len(match.ends(1)), match.end()

    @staticmethod
    def _checked(match: regex.Match | None) -> regex.Match:
        if match is None:
            raise ValueError("units do not cover the text")
        return match

    def end(self, k: int) -> int:
        """Characters of the first ``k`` units."""
        if k == 0:
            return 0
        if not self._starts:
            return self._ends[k - 1]
        before, at = next(s for s in reversed(self._starts) if s[0] < k)
        return self._part.match(self._text, at).ends(1)[k - before - 1]


def draws(doc_id: int | None, seed: int = 1) -> list[int]:
    """The first four 8-digit groups of the hash of ``seed`` and id as numbers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", unit: str = UNIT, rate: int = RATE, spm: int = SPM, seed: int = 1, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n`` units, ``form``, units and characters of prefix and middle, and ``output`` of every row.

    ``form`` is ``plain``, ``psm`` (prefix, suffix, middle) or ``spm``. The sizes are
    null for plain rows.
    """

    def one(key: int | None, t: str) -> tuple:
        units = Units(t, unit, window)
        n = units.n
        h1, h2, h3, h4 = draws(key, seed)
        if not t or any(m in t for m in MARKERS) or h3 % 100 >= rate:
            return key, n, "plain", None, None, None, None, t
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = units.end(first), units.end(second)
        prefix, middle, suffix = t[:a], t[a:b], t[b:]
        if h4 % 100 < spm:
            return key, n, "spm", first, second - first, a, b - a, "".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
        return key, n, "psm", first, second - first, a, b - a, "".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            rows = [one(k, t or "") for k, t in zip(column(block, "doc_id").to_pylist(), column(block, "text").to_pylist())]
            kinds = (pa.int64(), pa.int64(), pa.string(), *(pa.int64(),) * 4, pa.string())
            names = ("doc_id", "n", "form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, RESULT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, rebuilt from its output and form."""
    part = F.split(output, "|".join(MARKERS), -1)
    psm = F.concat(part[1], part[3], part[2])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", F.concat(part[2], part[3], part[1])).otherwise(F.col(output))


#: The result of ``op11`` in DuckDB's SQL.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(x, 17, 8))::BIGINT % 100 AS r3, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS r4 FROM d),
f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR r3 >= {RATE} THEN 'plain' WHEN r4 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1, n - b) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
