"""Membership in a dictionary, tested in the row's own expression (X5, J1, J2): no join, no exchange.

A bounded dictionary becomes a hash table inside the plan: an array literal with one string per hash
bucket, so a test is one array access and one substring search, exact, and rows stay where they are.
A larger one becomes a Bloom filter of bounded size, built in Spark (positions are turned into bits per word,
combined before the shuffle); it never rejects a member, and the few candidates that pass are then verified
by a join over narrow columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest dictionary whose words may pass through the driver into the plan (some 10 bytes a word).
EXACT_WORDS = 100_000
#: Most bits of a Bloom filter (4 MB); a dictionary of more words gets a weaker filter, which stays correct.
MAX_BITS = 1 << 25
HASHES = 4
_BUCKET, _WORD = "\x01", "\x02"


def exact_test(words: list[str]) -> Callable[[Column], Column]:
    """``test(column)``: whether a value is one of ``words`` (false for null). Words may not hold the characters 1 and 2."""
    if any(_BUCKET in w or _WORD in w for w in words):
        raise ValueError("a dictionary word holds a control character")
    known = sorted(set(words))
    n = 1 << max(0, (len(known) // 2).bit_length())
    buckets = [_WORD] * n
    for w in known:
        buckets[_bucket_of(w, n)] += w + _WORD
    table = F.split(F.lit(_BUCKET.join(buckets)), _BUCKET)  # folded into an array literal

    def test(c: Column) -> Column:
        own = F.get(table, F.crc32(c.cast("binary")).bitwiseAND(n - 1).cast("int"))
        return F.coalesce(F.contains(own, F.concat(F.lit(_WORD), c, F.lit(_WORD))), F.lit(False))

    return test


def _bucket_of(word: str, n: int) -> int:
    import zlib
    return zlib.crc32(word.encode()) & (n - 1)


def _positions(c: Column, bits: int) -> list[Column]:
    first, second = F.xxhash64(c), F.xxhash64(c, F.lit("second"))
    return [F.pmod(first + k * F.pmod(second, F.lit(bits)), F.lit(bits)) for k in range(HASHES)]


def bloom_test(words: DataFrame, count: int) -> Callable[[Column], Column]:
    """``test(column)`` for the one-column frame ``words`` of about ``count`` rows: true for every member, false for
    most others (and for null). The filter's words (``MAX_BITS`` / 64 numbers at most) pass through the driver."""
    bits = 64
    while bits < min(10 * count, MAX_BITS):
        bits *= 2
    value = words.select(F.col(words.columns[0]).alias("w")).where("w IS NOT NULL")
    places = value.select(F.explode(F.array(*_positions(F.col("w"), bits))).alias("p"))
    filled = places.groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    own = dict(filled.collect())
    table = F.split(F.lit(",".join(str(own.get(k, 0)) for k in range(bits // 64))), ",").cast("array<bigint>")

    def test(c: Column) -> Column:
        hit = F.lit(True)
        for p in _positions(c, bits):
            hit = hit & (F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1)
        return F.coalesce(c.isNotNull() & hit, F.lit(False))

    return test
