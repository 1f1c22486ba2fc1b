"""Mixing sources to target weights by temperature (operator 8, native).

Token shares of the sources are raised to an exponent found by bisection: the largest that keeps a target entropy or a
repetition limit. The normalised weights are realised as budgeted block permutations: each source's documents are
permuted once an epoch, as many as its share of the token budget asks for, and all sources are interleaved in blocks in
proportion to their weights.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialise, text_or_empty

BISECTIONS = 60
#: A permutation's cumulative sums are taken in ranges of its keys, so no source is one task's: rows of a range if all are one source's, least and most ranges. Their number doesn't change the order.
ROWS_PER_RANGE, RANGES = 20_000, (64, 65_536)
#: Most sources whose weights are bisected on the driver; a column with more isn't one of sources.
MAX_SOURCES = 100_000
#: Tokens of a block.
BLOCK_TOKENS = 100_000


def weights(shares: dict[str | None, float], exponent: float) -> dict[str | None, float]:
    raised = {s: p**exponent for s, p in shares.items() if p > 0}
    total = sum(raised.values())
    return {s: raised.get(s, 0.0) / total if total else 0.0 for s in shares}


def entropy(w: dict[str | None, float]) -> float:
    return -sum(p * math.log(p) for p in w.values() if p > 0)


def fit_exponent(shares: dict[str | None, float], min_entropy: float | None = None, max_repetition: float | None = None) -> float:
    """The exponent in [0, 1] by bisection. With ``min_entropy`` (nats): the largest whose weights reach it (0 if none does).
    With ``max_repetition``: the smallest for which no source is repeated more than that while the least repeated source is used once."""

    def holds(exponent: float) -> bool:
        w = weights(shares, exponent)
        if min_entropy is not None:
            return entropy(w) >= min_entropy
        ratios = [w[s] / shares[s] for s in shares if shares[s] > 0]
        return not ratios or max(ratios) / min(ratios) <= max_repetition

    if min_entropy is not None:
        low, high = 0.0, 1.0
        if holds(1.0):
            return 1.0
        for _ in range(BISECTIONS):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low
    low, high = 0.0, 1.0
    if holds(0.0):
        return 0.0
    for _ in range(BISECTIONS):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def n_tokens(text: Column) -> Column:
    """Words of a text; one at least, so that every document has a place in the budget."""
    return F.greatest(F.regexp_count(text, F.lit(r"\S++")), F.lit(1)).cast("long")


def plan(sizes: DataFrame, min_entropy: float | None = None, max_repetition: float | None = 2.0) -> list[tuple]:
    """Per source: (source, tokens, share, weight, epochs), epochs being its part of the budget over its tokens.

    ``sizes`` has source and tokens. The budget is the least for which every source is used whole at least once, so
    mixing repeats documents but leaves none out. A null source is a source; more than MAX_SOURCES are an error.
    """
    totals = [(r.source, int(r.tokens)) for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(MAX_SOURCES + 1).collect()]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix by a column with fewer values")
    total = sum(t for _, t in totals)
    shares = {s: t / total for s, t in totals}
    w = weights(shares, fit_exponent(shares, min_entropy, max_repetition))
    budget = max((t / w[s] for s, t in totals if w[s] > 0), default=0.0)
    return [(s, t, shares[s], w[s], max(1.0, w[s] * budget / t)) for s, t in sorted(totals, key=lambda x: (x[0] is not None, x[0]))]


def mix(docs: DataFrame, min_entropy: float | None = None, max_repetition: float | None = 2.0, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per use of a document: doc_id, text_crc32, source, n_tokens, weight, epoch (from 0), block and order key.

    Each whole epoch uses every document of the source; the last, partial one uses documents in permuted order until
    the budget is met (to within one document). Null ids, texts (one token) and sources count; repeated rows are used
    like others. An empty table gives no rows; other columns are not read. Only ids and counts are shuffled.
    """
    body = text_or_empty(text_col)
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_tokens(body).alias("tokens"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    sizes = materialise(sizes)
    planned = plan(sizes, min_entropy, max_repetition)
    blocks = max(1, math.ceil(sum(t * epochs for _, t, _, _, epochs in planned) / BLOCK_TOKENS))
    by_source = sizes.sparkSession.createDataFrame(planned, "_source string, source_tokens long, share double, weight double, epochs double")
    joined = sizes.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    last = F.floor("epochs").cast("int")
    uses = joined.select("*", F.explode(F.sequence(F.lit(0), last)).alias("epoch"))
    uses = uses.withColumn("order_key", F.xxhash64(F.lit(seed), "epoch", "source", "doc_id", "text_crc32"))
    ranges = min(RANGES[1], max(RANGES[0], math.ceil(sizes.count() / ROWS_PER_RANGE)))
    uses = uses.withColumn("_bucket", F.shiftrightunsigned(F.shiftrightunsigned("order_key", 32) * ranges, 32))
    # tokens before a document in its epoch's permutation: whole buckets before, then the running sum in the bucket
    sums = uses.groupBy("source", "epoch", "_bucket").agg(F.sum("tokens").alias("_sum"))
    over = Window.partitionBy("source", "epoch").orderBy("_bucket")
    sums = sums.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("_bucket").alias("_b"), (F.sum("_sum").over(over) - F.col("_sum")).alias("_base"))
    inner = Window.partitionBy("source", "epoch", "_bucket").orderBy("order_key", "doc_id", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = uses.withColumn("_within", F.coalesce(F.sum("tokens").over(inner), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("_bucket") == F.col("_b"))
    placed = placed.join(sums, on)
    at = F.col("epoch") + (F.col("_base") + F.col("_within")) / F.col("source_tokens")
    placed = placed.withColumn("_at", at).where(F.col("_at") < F.col("epochs"))
    progress = F.col("_at") / F.col("epochs")
    return placed.select("doc_id", "text_crc32", "source", F.col("tokens").alias("n_tokens"), "weight", "epoch", F.floor(progress * blocks).cast("long").alias("block"), "order_key")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix uses them; all columns stay, whatever their names."""
    id_col, text_col, source_col = how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("source_col", "source")
    keyed = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.crc32(F.encode(text_or_empty(text_col), "UTF-8")).alias("_crc"), F.col(source_col).cast("string").alias("_source"))
    uses = mix(docs, **how).groupBy(F.col("doc_id").alias("_i"), F.col("text_crc32").alias("_c"), F.col("source").alias("_o")).agg(F.count("*").alias("_uses"))
    rows = keyed.groupBy(F.col("_id").alias("_i"), F.col("_crc").alias("_c"), F.col("_source").alias("_o")).agg(F.count("*").alias("_rows"))
    same = F.col("_i").eqNullSafe(F.col("_i2")) & (F.col("_c") == F.col("_c2")) & F.col("_o").eqNullSafe(F.col("_o2"))
    counts = uses.join(rows.select(F.col("_i").alias("_i2"), F.col("_c").alias("_c2"), F.col("_o").alias("_o2"), "_rows"), same).select("_i", "_c", "_o", F.expr("_uses div _rows").alias("_each"), F.expr("_uses % _rows").alias("_rest"))
    on = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_crc") == F.col("_c")) & F.col("_source").eqNullSafe(F.col("_o"))
    counts = materialise(counts)
    copies = F.col("_each")
    if not counts.where("_rest > 0").isEmpty():  # repeated rows whose uses don't come out even
        order = Window.partitionBy("_i", "_c", "_o").orderBy(F.lit(0))
        copies = copies + F.when(F.row_number().over(order) <= F.col("_rest"), 1).otherwise(0)
    joined = keyed.join(counts, on).select("_row", copies.cast("int").alias("_n"))
    return joined.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_use")).select("_row.*")
