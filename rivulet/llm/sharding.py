"""Sharding by a Feistel permutation with cycle walking over global row numbers (operator 6, native)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import text_or_empty

#: Rows that one numbering bucket should hold, and the most buckets there are: the table of bucket offsets has a fixed bound.
ROWS_PER_BUCKET, MAX_BUCKETS = 2_000, 65_536
ROUNDS = 6
#: Steps of a cycle walk. Below 2**14 rows no walk can be longer (each step visits another surplus point); above, a longer one has a chance below 1e-300.
MAX_WALK = 300


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("long"))


def feistel(value: Column, side: int, seed: int, rounds: int = ROUNDS) -> Column:
    """A keyed bijection of [0, side * side): both halves are numbers below ``side``; each round adds a hash of one half to the other."""
    left, right = _div(value, side), value % F.lit(side).cast("long")
    for key in range(rounds):
        mixed = F.pmod(F.xxhash64(F.lit(seed), F.lit(key), right), F.lit(side).cast("long"))
        left, right = right, (left + mixed) % F.lit(side).cast("long")
    return left * F.lit(side).cast("long") + right


def permuted(value: Column, n: int, seed: int) -> Column:
    """The keyed permutation of [0, n): the Feistel network over the smallest square that holds n, walked until it is back below n."""
    side = math.isqrt(max(n, 1) - 1) + 1
    first = feistel(value, side, seed)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(MAX_WALK)),
        first,
        lambda at, _: F.when(at < n, at).otherwise(feistel(at, side, seed)),
    )
    checked = F.transform(F.array(walk), lambda at: F.when(at < n, at).otherwise(F.raise_error(f"no place within {MAX_WALK} steps").cast("long")))
    return F.when(first < n, first).otherwise(F.get(checked, F.lit(0)))


def row_numbers(rows: DataFrame, n: int) -> DataFrame:
    """Numbers the rows of ``rows`` 0 to n - 1 as ``row_number``, in an order that depends on their values alone.

    Equal rows are counted before the shuffle and get consecutive numbers, so no value is hot. Buckets are hashes of
    whole rows; their offsets are a running sum over at most MAX_BUCKETS counts.
    """
    names = rows.columns
    buckets = min(MAX_BUCKETS, max(1, math.ceil(n / ROWS_PER_BUCKET)))
    bucket = F.pmod(F.xxhash64(*names), F.lit(buckets))
    groups = rows.groupBy(*names).agg(F.count("*").alias("_copies")).withColumn("_bucket", bucket)
    offsets = groups.groupBy("_bucket").agg(F.sum("_copies").alias("_rows"))
    offsets = offsets.select("_bucket", (F.sum("_rows").over(Window.orderBy("_bucket")) - F.col("_rows")).alias("_offset"))
    before = F.sum("_copies").over(Window.partitionBy("_bucket").orderBy(*names)) - F.col("_copies")
    numbered = groups.withColumn("_before", before).join(F.broadcast(offsets), "_bucket")
    start = F.col("_offset") + F.col("_before")
    return numbered.select(*names, F.explode(F.sequence(start, start + F.col("_copies") - 1)).alias("row_number"))


def shard_rows(docs: DataFrame, n_shards: int = 16, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals all rows into ``n_shards`` shards by a reproducible shuffle.

    Row i of the value order goes to p = permutation(i); its shard is p mod n_shards and its slot p div n_shards, so
    shard sizes differ by one at most, slots have no gaps and any reader can compute where a row lies. Null ids and
    texts are values like others (a null text has no bytes), repeated rows keep one place each, an empty table gives
    no rows; other columns are not read. Only (id, size, crc32) is shuffled, never the text.
    """
    body = F.encode(text_or_empty(text_col), "UTF-8")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    n = docs.count()
    place = permuted(F.col("row_number"), n, seed)
    placed = row_numbers(rows, n).withColumn("_place", place)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        (F.col("_place") % n_shards).cast("int").alias("shard"), _div(F.col("_place"), n_shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


def inverse(place: int, n: int, seed: int, hash64) -> int:
    """The row number at ``place``: the network run backwards, for readers that look one place up. ``hash64(seed, key, half)`` is Spark's xxhash64."""
    side = math.isqrt(max(n, 1) - 1) + 1
    while True:
        left, right = divmod(place, side)
        for key in reversed(range(ROUNDS)):
            left, right = (right - hash64(seed, key, left) % side) % side, left
        place = left * side + right
        if place < n:
            return place
