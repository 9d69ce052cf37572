"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line is described by counts over its bytes
and words and by those of its two neighbours; transitions tie neighbouring
labels. Forward-backward marginals of the label good, weighted by line length,
give the document's quality, which a logistic curve fitted on the same sample
turns into a probability, the score.

The field is fitted by L-BFGS on the driver from a bounded sample of labelled
documents (``sample`` of those that have at most ``sample_lines`` lines, in the order
of a hash of the doc_id; of its different texts the one of least hash); each line takes its document's label. Scoring
reads every whole text and needs no shuffle.

Defined results: a null or empty text is one empty line and gets the score of
that. A doc_id that is null is never learnt from. Repeated labels of a doc_id
count as one by majority (ties: good); labels without quality are ignored. With
no usable labels, or labels of one kind only, every score is 0.5. An empty table gives no rows.
A text of more than a window of bytes is described in windows that end between
words (a line may go on over many), and its lines are weighed some thousands at a
time: what is held grows with its lines and with the distinct words of a line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, column, text_bytes
from .words import _BREAK, WINDOW, windows, words

#: Bounds of the sample that the field is fitted on.
SAMPLE, SAMPLE_LINES = 3_000, 80
THRESHOLD = 0.3
#: Share of frequent words (fixed values) in a line tells prose from tables.
FREQUENT = "the of and to in is that a an der die das und den le la les de des et el los que y en un une"
_CLASSES = ("upper", "lower", "digit", "space", "bang", "bar", "mark", "stop", "wide")


def _classes() -> np.ndarray:
    out = np.zeros((256, len(_CLASSES)), bool)
    for c in range(128):
        x = chr(c)
        out[c] = (x.isupper(), x.islower(), x.isdigit(), x.isspace(), x == "!", x == "|", x in "#$%&*@^~=<>{}[]\\/_+", x in ".,;:?'\"()-", False)
    out[128:, -1] = True
    return out


_TABLE = _classes()
N_OWN = len(_CLASSES) + 9


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of texts laid end to end, the texts' line offsets, and line lengths."""
    breaks = np.flatnonzero(data == 10) + 1
    first = np.searchsorted(breaks, offsets[:-1], "right")
    last = np.searchsorted(breaks, offsets[1:], "right")
    # every text starts a line; a break starts one unless its text ends there (that last line is empty, but a line)
    number = last - first + 1
    at = np.append(0, np.cumsum(number))
    begin = np.empty(at[-1], np.int64)
    begin[at[:-1]] = offsets[:-1]
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    begin[inner] = breaks[: inner.sum()] if len(breaks) == inner.sum() else breaks[np.concatenate([np.arange(a, b) for a, b in zip(first, last)])]
    text = np.repeat(np.arange(len(number)), number)
    end = np.append(begin[1:], offsets[-1])
    end[at[1:] - 1] = offsets[1:]
    size = end - begin
    long = np.maximum(size, 1)
    own = np.zeros((len(begin), N_OWN), np.float32)
    for k in range(len(_CLASSES)):
        sums = np.append(0, np.cumsum(_TABLE[data, k], dtype=np.int64))
        own[:, k] = (sums[end] - sums[begin]) / long
    hashes, start, _ = words(data, offsets, lower=False)
    in_line = np.searchsorted(begin, start, "right") - 1
    count = np.bincount(in_line, minlength=len(begin))
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (in_line[1:] == in_line[:-1]))[: len(hashes)]
    lowered, _, _ = words(data, offsets)
    some = np.frombuffer(FREQUENT.encode(), np.uint8)
    common = np.isin(lowered, words(some, np.array([0, len(some)]))[0])
    k = len(_CLASSES)
    share = lambda mask: np.bincount(in_line[mask], minlength=len(begin)) / np.maximum(count, 1)
    own[:, k] = np.log1p(size) / 8
    own[:, k + 1] = np.minimum(size / np.maximum(count, 1) / 10, 3)
    own[:, k + 2] = share(same)
    own[:, k + 3] = share(common)
    line_hash = np.zeros(len(begin), np.uint64)
    np.add.at(line_hash, in_line, hashes * (np.arange(len(hashes), dtype=np.uint64) - np.searchsorted(in_line, in_line).astype(np.uint64) + np.uint64(1)))
    order = np.lexsort((line_hash, text))
    twice = np.append(False, (line_hash[order][1:] == line_hash[order][:-1]) & (text[order][1:] == text[order][:-1]))
    again = np.zeros(len(begin))
    again[order] = twice & (size[order] > 8)
    own[:, k + 4] = again
    distinct_order = np.lexsort((hashes, in_line))
    new = np.append(True, (hashes[distinct_order][1:] != hashes[distinct_order][:-1]) | (in_line[distinct_order][1:] != in_line[distinct_order][:-1]))[: len(hashes)]
    own[:, k + 5] = np.bincount(in_line[distinct_order][new], minlength=len(begin)) / np.maximum(count, 1)
    own[:, k + 6] = size == 0
    own[:, k + 7] = np.minimum(count, 40) / 40
    own[:, k + 8] = np.log1p(number[text]) / 8
    has_before, has_after = np.ones(len(begin), bool), np.ones(len(begin), bool)
    has_before[at[:-1]] = False
    has_after[at[1:] - 1] = False
    return _with_neighbours(own, has_before, has_after), at, size


def _with_neighbours(own: np.ndarray, has_before: np.ndarray, has_after: np.ndarray) -> np.ndarray:
    neighbours = np.zeros((len(own), 2 * N_OWN + 2), np.float32)
    neighbours[1:, :N_OWN] = own[:-1]
    neighbours[:-1, N_OWN : 2 * N_OWN] = own[1:]
    neighbours[~has_before, :N_OWN] = 0
    neighbours[~has_after, N_OWN : 2 * N_OWN] = 0
    neighbours[:, -2], neighbours[:, -1] = ~has_before, ~has_after
    return np.hstack([own, neighbours, np.ones((len(own), 1), np.float32)])


def long_lines(data: np.ndarray, most: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The own features and the lengths of all lines of one text, ``most`` bytes at a time."""
    begin = np.concatenate([[0], *(np.flatnonzero(data[a : a + most] == 10) + a + 1 for a in range(0, len(data), most))]).astype(np.int64)
    end = np.append(begin[1:], len(data))
    size = end - begin
    n, k = len(begin), len(_CLASSES)
    kinds = np.zeros((n, k), np.int64)
    count, same, common, distinct = (np.zeros(n, np.int64) for _ in range(4))
    line_hash = np.zeros(n, np.uint64)
    some = np.frombuffer(FREQUENT.encode(), np.uint8)
    frequent = words(some, np.array([0, len(some)]))[0]
    last, last_line, seen = np.uint64(0), -1, np.zeros(0, np.uint64)  # the word before, its line, the line's distinct words so far
    for a, b in windows(data, _BREAK, most):
        lines = slice(int(np.searchsorted(begin, a, "right")) - 1, int(np.searchsorted(begin, b - 1, "right")))
        lo = lines.start
        for c in range(k):
            sums = np.append(0, np.cumsum(_TABLE[data[a:b], c], dtype=np.int64))
            kinds[lines, c] += sums[np.clip(end[lines] - a, 0, b - a)] - sums[np.clip(begin[lines] - a, 0, b - a)]
        hashes, start, _ = words(data[a:b], np.array([0, b - a]), lower=False)
        if not len(hashes):
            continue
        lowered, _, _ = words(data[a:b], np.array([0, b - a]))
        in_line = np.searchsorted(begin, start + a, "right") - 1
        tally = lambda mask: np.bincount(in_line[mask] - lo, minlength=lines.stop - lo)
        place = np.arange(len(hashes)) - np.searchsorted(in_line, in_line) + count[in_line] + 1
        np.add.at(line_hash, in_line, hashes * place.astype(np.uint64))
        count[lines] += tally(slice(None))
        same[lines] += tally((hashes == np.append(last, hashes[:-1])) & (in_line == np.append(last_line, in_line[:-1])))
        common[lines] += tally(np.isin(lowered, frequent))
        order = np.lexsort((hashes, in_line))
        h, line = hashes[order], in_line[order]
        new = np.append(True, (h[1:] != h[:-1]) | (line[1:] != line[:-1]))
        h, line = h[new], line[new]
        distinct[lines] += np.bincount(line - lo, minlength=lines.stop - lo)
        if line[0] == last_line:
            seen = np.union1d(seen, h[line == last_line])
            distinct[last_line] = len(seen)
        if line[-1] != last_line:
            seen = h[line == line[-1]]
        last, last_line = hashes[-1], int(in_line[-1])
    own = np.zeros((n, N_OWN), np.float32)
    words_of = np.maximum(count, 1)
    own[:, :k] = kinds / np.maximum(size, 1)[:, None]
    own[:, k] = np.log1p(size) / 8
    own[:, k + 1] = np.minimum(size / words_of / 10, 3)
    own[:, k + 2] = same / words_of
    own[:, k + 3] = common / words_of
    order = np.argsort(line_hash, kind="stable")
    own[order[1:], k + 4] = (line_hash[order][1:] == line_hash[order][:-1]) & (size[order[1:]] > 8)
    own[:, k + 5] = distinct / words_of
    own[:, k + 6] = size == 0
    own[:, k + 7] = np.minimum(count, 40) / 40
    own[:, k + 8] = np.log1p(n) / 8
    return own, size


@dataclass
class Field:
    """Weights of the label good (bad: 0), and log potentials of going from one label to the next."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def quality(self, features: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log odds of the documents' mean marginals, weighted by line length."""
        return self.odds(features @ self.weights, at, size)

    def odds(self, score: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The same from the lines' scores."""
        good, _, _ = self.chain(score, at)
        weight = np.append(0, np.cumsum(size + 1.0))
        total = np.append(0, np.cumsum(good * (size + 1.0)))
        mean = np.clip((total[at[1:]] - total[at[:-1]]) / (weight[at[1:]] - weight[at[:-1]]), 1e-9, 1 - 1e-9)
        return np.log(mean / (1 - mean))

    def scores(self, features: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return self.curve(self.quality(features, at, size))

    def curve(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * quality + self.shift, -700, 700)))

    def long_score(self, data: np.ndarray, most: int = WINDOW, lines: int = 4_096) -> np.ndarray:
        """The score of one text, ``most`` bytes and ``lines`` lines at a time."""
        own, size = long_lines(data, most)
        n = len(own)
        score = np.empty(n)
        for a in range(0, n, lines):
            first, stop = max(a - 1, 0), min(a + lines + 1, n)
            at = np.arange(first, stop)
            features = _with_neighbours(own[first:stop], at > 0, at < n - 1)
            score[a : a + lines] = features[a - first : a - first + lines] @ self.weights
        del own
        return self.curve(self.odds(score, np.array([0, n]), size))

    def calibrate(self, quality: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> None:
        """Fit the curve's slope and shift by Newton's method with an L2 penalty on the slope."""
        x = np.stack([quality, np.ones(len(quality))], 1)
        p = np.array([1.0, 0.0])
        ridge = np.array([penalty, penalty * 1e-2])
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
            slope = x.T @ (q - labels) / len(x) + ridge * p
            bend = (x * (q * (1 - q))[:, None]).T @ x / len(x) + np.diag(ridge)
            move = np.linalg.solve(bend, slope)
            p = p - move * min(1.0, 2.0 / (np.abs(move).max() + 1e-12))
        if p[0] > 0:  # else the sample says nothing on order
            self.slope, self.shift = float(p[0]), float(p[1])

    def marginals(self, features: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of every line, summed P(label, next label), and the summed log partition."""
        return self.chain(features @ self.weights, at)

    def chain(self, score: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """The same from the lines' scores."""
        score = np.clip(score, -30, 30).astype(np.float64)
        number = np.diff(at)
        order = np.argsort(-number, kind="stable")
        start, number = at[:-1][order], number[order]
        steps = np.exp(self.moves)
        emit = np.exp(score)
        forward, scale = np.empty((len(score), 2)), np.empty(len(score))
        backward = np.ones((len(score), 2))
        active = np.searchsorted(-number, -np.arange(1, (number[0] if len(number) else 0) + 1), "right")
        for t, m in enumerate(active.tolist()):
            now = start[:m] + t
            a = np.ones((m, 2)) if t == 0 else forward[now - 1] @ steps
            a[:, 1] *= emit[now]
            scale[now] = a.sum(1)
            forward[now] = a / scale[now][:, None]
        for t in range(len(active) - 2, -1, -1):
            now = start[: active[t + 1]] + t
            b = backward[now + 1].copy()
            b[:, 1] *= emit[now + 1]
            backward[now] = (b @ steps.T) / scale[now + 1][:, None]
        both = forward * backward
        good = both[:, 1] / both.sum(1)
        inner = np.ones(len(score), bool)
        inner[at[1:] - 1] = False
        i = np.flatnonzero(inner)
        nxt = backward[i + 1].copy()
        nxt[:, 1] *= emit[i + 1]
        pairs = (forward[i] / scale[i + 1][:, None]).T @ nxt * steps
        return good, pairs, float(np.log(scale).sum())


def fit(features: np.ndarray, at: np.ndarray, labels: np.ndarray, penalty: float = 1e-3, rounds: int = 80) -> Field:
    """Maximum likelihood with an L2 penalty by L-BFGS; ``labels`` are of documents."""
    mean, spread = features.mean(0), features.std(0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    scaled = (features - mean) / spread
    y = np.repeat(labels, np.diff(at)).astype(np.float64)
    inner = np.ones(len(y), bool)
    inner[at[1:] - 1] = False
    i = np.flatnonzero(inner)
    seen = np.array([[((y[i] == a) & (y[i + 1] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    n = len(y)

    def value(p: np.ndarray) -> tuple[float, np.ndarray]:
        field = Field(p[:-4], p[-4:].reshape(2, 2))
        good, pairs, logs = field.marginals(scaled, at)
        score = np.clip(scaled @ p[:-4], -30, 30)
        loss = logs - (y * score).sum() - (seen * field.moves).sum()
        slope = np.append(scaled.T @ (good - y), (pairs - seen).ravel())
        return loss / n + penalty * (p @ p), slope / n + 2 * penalty * p

    p = np.zeros(features.shape[1] + 4)
    f, g = value(p)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, stack = -g, []
        for s, z in reversed(kept):
            a = (s @ d) / (s @ z)
            stack.append(a)
            d = d - a * z
        if kept:
            s, z = kept[-1]
            d = d * (s @ z) / (z @ z)
        for (s, z), a in zip(kept, reversed(stack)):
            d = d + (a - (z @ d) / (s @ z)) * s
        step = 1.0 if kept else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        while step > 1e-10:
            f2, g2 = value(p + step * d)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, z = step * d, g2 - g
        if s @ z > 1e-12:
            kept = [*kept, (s, z)][-8:]
        done = f - f2 < 1e-7
        p, f, g = p + s, f2, g2
        if done:
            break
    weights = p[:-4] / spread
    weights[-1] -= (p[:-4] * mean / spread)[:-1].sum()
    return Field(weights, p[-4:].reshape(2, 2))


def _quality(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, *, sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Field | None:
    """Fit the field on the bounded sample; ``usable`` is a condition on the labels' doc_id."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    if usable is not None:
        known = known.filter(usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    texts = _quality(docs).withColumn("t", F.coalesce("text", F.lit(""))).withColumn("by", F.struct(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(7), "t").alias("b")))
    fits = texts.filter(F.size(F.split("t", "\n")) <= sample_lines).join(known, "doc_id", "left_semi")
    # names first: one text for each doc_id by hash, then the bounded choice, then only the texts chosen
    named = fits.groupBy("doc_id").agg(F.min("by").alias("by")).join(known, "doc_id")
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("own"), F.col("by").alias("first"), "quality")
    found = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("own")) & (F.col("by") == F.col("first")))
    texts = found.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.first("text").alias("text"))  # equal texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            data, offsets = text_bytes(column(block, "text"))
            if block.num_rows == 1 and len(data) > WINDOW:
                own, size = long_lines(data)
                at = np.array([0, len(own)])
                features = _with_neighbours(own, np.arange(at[1]) > 0, np.arange(at[1]) < at[1] - 1)
            else:
                features, at, size = line_features(data, offsets)
            rows = [features[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            sizes = [size[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([column(block, "doc_id"), column(block, "quality"), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], ["doc_id", "quality", "features", "sizes"])

    got = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, features binary, sizes binary").toPandas()  # at most sample * sample_lines lines
    got = got.sort_values("doc_id")
    if got.quality.nunique() < 2:
        return None
    parts = [np.frombuffer(f, np.float32).reshape(-1, 3 * N_OWN + 3) for f in got.features]
    features, at, labels = np.concatenate(parts).astype(np.float64), np.append(0, np.cumsum([len(p) for p in parts])), got.quality.to_numpy()
    field = fit(features, at, labels)
    field.calibrate(field.quality(features, at, np.frombuffer(b"".join(got.sizes), np.int64)), labels)
    return field


def scores(docs: DataFrame, field: Field | None) -> DataFrame:
    """``score`` (0 to 1, higher: better) beside the columns of ``docs``, of which ``text`` must be one."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            if field is None:
                score = np.full(block.num_rows, 0.5)
            else:
                data, offsets = text_bytes(column(block, "text"))
                long = block.num_rows == 1 and len(data) > WINDOW
                score = field.long_score(data) if long else field.scores(*line_features(data, offsets))
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(np.clip(score, 0, 1))], [*names, "score"])

    if "score" in names:
        raise ValueError("docs has a column named score")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
