"""Array columns: index plans, masks, pooling, padding, n-gram scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_plan(total: Column, n: int, start: Column | None = None, end: Column | None = None) -> Column:
    """``n`` positions spread evenly from ``start`` to the one before ``end``, cut to whole numbers within ``total``."""
    first = F.coalesce(start, F.lit(0)).cast("double") if start is not None else F.lit(0.0)
    last = F.greatest((end if end is not None else total).cast("double") - 1, first)
    step = (last - first) / F.lit(max(n - 1, 1))
    spread = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i == n - 1) & F.lit(n > 1), last).otherwise(first + i * step).cast("long"))
    return F.transform(spread, lambda i: F.least(F.greatest(i, F.lit(0)), total.cast("long") - 1))


def nearest_valid(values: Column, valid: Column) -> Column:
    """Each invalid place takes the value of the nearest valid one (ties: the earlier); without a valid one nothing changes."""
    at = F.transform(valid, lambda m, i: F.when(m, i))

    def carried(places: Column) -> Column:
        """The last place that is not null, at each place."""
        start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("out"))
        step = lambda a, x: F.struct(F.coalesce(x, a.last).alias("last"), F.concat(a.out, F.array(F.coalesce(x, a.last))).alias("out"))
        return F.aggregate(places, start, step, lambda a: a.out)

    both = F.zip_with(carried(at), F.reverse(carried(F.reverse(at))), lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    near = F.transform(both, lambda p, i: F.when(p.a.isNull() | (i - p.b <= p.a - i), p.b).otherwise(p.a))
    return F.when(F.exists(valid, lambda m: m), F.transform(near, lambda j: F.get(values, j))).otherwise(values)


def roll(values: Column, by: int) -> Column:
    """Circular shift to the right."""
    n = F.size(values)
    k = F.pmod(F.lit(by), n)
    return F.when(n > 0, F.concat(F.slice(values, n - k + 1, k), F.slice(values, F.lit(1), n - k))).otherwise(values)


def strided(values: Column, stride: int, most: int) -> Column:
    return F.slice(F.filter(values, lambda x, i: i % stride == 0), 1, most)


def bin_bounds(n: Column, bins: int) -> Column:
    """Bins of ``n`` places as (first place from 1, length): equal, or the first ``n mod bins`` one longer."""
    short = F.floor(n / bins)
    long = n % bins
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.struct((b * short + F.least(b, long) + 1).cast("int").alias("first"), (short + F.when(b < long, 1).otherwise(0)).cast("int").alias("length")))


def masked_pool(values: Column, mask: Column, bins: int, fallback: float = 0.0) -> Column:
    """Mean of the valid values of each bin; ``fallback`` where a bin has none. Fewer values than bins are an error."""

    def one(b: Column) -> Column:
        v, m = F.slice(values, b.first, b.length), F.slice(mask, b.first, b.length)
        kept = F.zip_with(v, m, lambda x, ok: F.when(ok, x.cast("double")).otherwise(F.lit(0.0)))
        count = F.size(F.filter(m, lambda ok: ok))
        return F.when(count > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.greatest(count, F.lit(1))).otherwise(F.lit(fallback))

    enough = F.size(values) >= bins
    return F.when(enough, F.transform(bin_bounds(F.size(values), bins), one)).otherwise(F.raise_error(F.lit("fewer tokens than bins")))


def coarse_mask(mask: Column, group: int, repeat: int) -> Column:
    """Groups of places, valid if any of them is, each repeated."""
    n = F.ceil(F.size(mask) / group).cast("int")
    any_valid = F.transform(F.sequence(F.lit(0), n - 1), lambda g: F.exists(F.slice(mask, g * group + 1, F.lit(group)), lambda m: m))
    return F.flatten(F.transform(any_valid, lambda m: F.array_repeat(m, repeat)))


def valid_fraction(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m)) / F.size(mask)


def masked_labels(prompt: Column, whole: Column, ignore: int = -100) -> Column:
    """Labels of ``whole`` with the prompt's length ignored; null if ``whole`` does not start with the prompt."""
    n = F.size(prompt)
    return F.when(F.slice(whole, F.lit(1), n) == prompt, F.concat(F.array_repeat(F.lit(ignore), n), F.slice(whole, n + 1, F.greatest(F.size(whole) - n, F.lit(0)))))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading values two arrays share."""
    apart = F.zip_with(F.slice(a, 1, F.greatest(F.least(F.size(a), F.size(b)), F.lit(0))), b, lambda x, y: x.eqNullSafe(y) & (x.isNotNull() | y.isNotNull()))
    first = F.array_position(apart, False)
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def supervised_labels(prompt: Column, whole: Column, most: int, ignore: int = -100) -> Column:
    """Labels of ``whole`` for training on what follows the prompt.

    Where a tokenizer joins the prompt's end with the answer's start, only the part
    that both have in common is the prompt. Nothing in common, nothing after it, or
    more than ``most`` tokens is an error, since nothing is cut off.
    """

    def of(n: Column) -> Column:
        told = lambda text: F.raise_error(text).cast("array<int>")
        labels = F.concat(F.array_repeat(F.lit(ignore), n), F.slice(whole, n + 1, F.greatest(F.size(whole) - n, F.lit(0))))
        return (
            F.when(F.size(whole) > most, told(F.concat(F.lit("an example has "), F.size(whole).cast("string"), F.lit(f" tokens, more than {most}"))))
            .when((n == 0) & (F.size(prompt) > 0), told(F.lit("the prompt is not a prefix of the supervised text")))
            .when(n >= F.size(whole), told(F.lit("no tokens remain after the prompt")))
            .otherwise(labels)
        )

    return let(common_prefix(prompt, whole), of)


def padded(values: Column, size: Column, pad: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(pad), F.greatest(size - F.size(values), F.lit(0))))


def attention(values: Column, size: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.size(values)), F.array_repeat(F.lit(0), F.greatest(size - F.size(values), F.lit(0))))


def standardized(values: Column, mean: float, std: float, scale: float = 255.0) -> Column:
    return F.transform(values, lambda x: (x / scale - mean) / std)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_grams(tokens: Column, n: int) -> Column:
    count = F.size(tokens) - n + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), "\u0001"))).otherwise(F.array().cast("array<string>"))


def bleu4(reference: Column, candidate: Column) -> Column:
    """BLEU-4 of token arrays against one reference (Papineni et al. 2002), uniform weights.

    A precision without a match counts 0.1 matches (Chen and Cherry 2014, method
    1); no common word, or an empty candidate, gives 0.
    """
    r, c = F.size(reference), F.size(candidate)

    def matches(n: int) -> Column:
        common = lambda own, other: F.transform(F.array_distinct(own), lambda g: F.least(F.size(F.filter(own, lambda x: x == g)), F.size(F.filter(other, lambda y: y == g))))
        clipped = let(n_grams(candidate, n), lambda own: let(n_grams(reference, n), lambda other: common(own, other)))
        return F.aggregate(clipped, F.lit(0), lambda a, x: a + x)

    def score(hits: Column) -> Column:
        logs = []
        for n in range(1, 5):
            hit, of = F.get(hits, F.lit(n - 1)), F.greatest(c - n + 1, F.lit(1))
            logs.append(F.log(F.when(hit > 0, hit.cast("double")).otherwise(F.lit(0.1)) / of))
        mean = sum(logs[1:], logs[0]) / 4
        brevity = F.when(c > r, F.lit(0.0)).otherwise(1 - r / c)
        return F.when((c == 0) | (F.get(hits, F.lit(0)) == 0), F.lit(0.0)).otherwise(F.exp(brevity + mean))

    return let(F.array(*(matches(n) for n in range(1, 5))), score)


def chat_text(turns: Column, template: str = "<|{}|>\n") -> Column:
    """Ordered (turn, role, text) structs as one prompt."""
    before, after = template.split("{}")
    return F.array_join(F.transform(F.array_sort(turns), lambda t: F.concat(F.lit(before), t.role, F.lit(after), t.text)), "\n")
