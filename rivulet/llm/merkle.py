"""Document fingerprints by Merkle trees (operator 7, native).

A text falls into sections (ended by blank lines), sections into paragraphs (ended by line ends) and paragraphs into
leaves: sentences, cut after LEAF_CHARS characters. Parts joined give the text back, so trees are equal only for equal
texts. A node's hash covers its children's hashes in order. A fingerprint is the root and the short codes of all nodes
below it, so that two fingerprints can be descended from their roots to the branches that differ.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import text_or_empty

LEAF_CHARS = 40
#: Hex digits of a leaf's and a branch's code; equal roots decide equality, codes only likeness.
CODE, BRANCH = 8, 16
#: Rows in a bucket of the order by id, and the most buckets (their bounds are a literal of fixed size).
ROWS_PER_BUCKET, MAX_BUCKETS = 2_000, 16_384

#: Possessive, so no character is read twice.
_LEAF = rf"[^.!?\n]{{1,{LEAF_CHARS}}}+[.!?\n]{{0,{LEAF_CHARS}}}+|[.!?\n]{{1,{LEAF_CHARS}}}+"


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "\n").cast("binary"), 256)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashes(nodes: Column) -> Column:
    return F.transform(nodes, lambda x: x["hash"])


def tree(text: Column) -> Column:
    """Sections (hash, paragraphs) of paragraphs (hash, leaves) of leaf hashes, built from the leaves up."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(_LEAF), F.lit(0)), lambda x: F.sha2(x.cast("binary"), 256))
    paragraph = lambda p: _bound(leaves(p), lambda x: F.struct(_hash(x).alias("hash"), x.alias("leaves")))
    section = lambda s: _bound(F.transform(F.split(s, "\n"), paragraph), lambda x: F.struct(_hash(_hashes(x)).alias("hash"), x.alias("paragraphs")))
    return F.transform(F.split(text, "\n\n"), section)


def root(nodes: Column) -> Column:
    return _hash(_hashes(nodes))


def branches(nodes: Column) -> Column:
    """The tree below the root, a string a section: code:leaves:paragraphs, a paragraph being its code and those of its leaves."""
    code = lambda h, n: F.substring(h, 1, n)
    paragraph = lambda p: F.concat(code(p["hash"], BRANCH), F.array_join(F.transform(p["leaves"], lambda h: code(h, CODE)), ""))
    size = lambda s: F.aggregate(s["paragraphs"], F.lit(0), lambda n, p: n + F.size(p["leaves"]))
    return F.transform(nodes, lambda s: F.concat_ws(":", code(s["hash"], BRANCH), size(s).cast("string"), F.array_join(F.transform(s["paragraphs"], paragraph), ",")))


def summary(text: Column) -> Column:
    """struct<root, branches> of a text."""
    return _bound(tree(text), lambda t: F.struct(root(t).alias("root"), branches(t).alias("branches")))


def _leaves(sections: Column, paragraphs: Column) -> Column:
    """How many leaves these sections and paragraphs have."""
    total = F.aggregate(sections, F.lit(0), lambda n, s: n + F.split_part(s, F.lit(":"), F.lit(2)).cast("int"))
    return F.aggregate(paragraphs, total, lambda n, p: n + F.call_function("div", F.length(p) - BRANCH, F.lit(CODE)).cast("int"))


def likeness(a: Column, b: Column) -> Column:
    """How alike two summaries are, found by descending both trees: 1 for equal roots, 0 without a common leaf or beside an empty text.

    Sections that both have are alike with all their leaves; only below the others are paragraphs compared, and leaves
    only below paragraphs that differ. Branches of one parent level are compared as sets, so what moved is no difference.
    The result is the share of common leaves in the larger tree, a branch counting once where it repeats.
    """
    below = lambda sections: F.flatten(F.transform(sections, lambda s: F.split(F.split_part(s, F.lit(":"), F.lit(3)), ",")))
    ends = lambda paragraphs: F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substr(p, F.lit(BRANCH + 1)), F.lit(f".{{{CODE}}}"), F.lit(0))))

    def level(x: Column, y: Column, use: Callable[[Column], Column]) -> Column:
        """``use`` of what x and y have in common and what each has alone."""
        return _bound(F.struct(F.array_intersect(x, y).alias("both"), F.array_except(x, y).alias("a"), F.array_except(y, x).alias("b")), use)

    def share(s: Column, p: Column, l: Column) -> Column:
        common = _leaves(s["both"], p["both"]) + F.size(l["both"])
        larger = common + F.greatest(F.size(l["a"]), F.size(l["b"]))
        return F.when(larger > 0, common / larger).otherwise(F.lit(0.0))

    paragraphs = lambda s: level(below(s["a"]), below(s["b"]), lambda p: leaves(s, p))
    leaves = lambda s, p: level(ends(p["a"]), ends(p["b"]), lambda l: share(s, p, l))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(level(a["branches"], b["branches"], paragraphs))


def fingerprint(of: Column) -> Column:
    """A summary as one string: root and branches."""
    return F.concat_ws("/", of["root"], F.array_join(of["branches"], "/"))


def differing(nodes_a: Column, nodes_b: Column) -> Column:
    """Where trees differ: positions (from 0) of the paragraphs whose hashes differ, in the sections whose hashes do."""
    places = lambda a, b: F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b), F.lit(1)) - 1)
    differs = lambda a, b, i: ~F.get(a, i)["hash"].eqNullSafe(F.get(b, i)["hash"])

    def within(i: Column) -> Column:
        none = F.filter(F.get(nodes_a, F.lit(0))["paragraphs"], lambda _: F.lit(False))
        a, b = (F.coalesce(F.get(nodes, i)["paragraphs"], none) for nodes in (nodes_a, nodes_b))
        return F.transform(F.filter(places(a, b), lambda j: differs(a, b, j)), lambda j: F.struct(i.alias("section"), j.alias("paragraph")))

    return F.flatten(F.transform(F.filter(places(nodes_a, nodes_b), lambda i: differs(nodes_a, nodes_b, i)), within))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, root, branches and the fingerprint string. A null text counts as empty; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), summary(text_or_empty(text_col)).alias("_tree"))
    return rows.select("doc_id", "_tree.root", "_tree.branches", fingerprint(F.col("_tree")).alias("fingerprint"))


def _bounds(docs: DataFrame, id_col: str, n: int) -> list[int]:
    buckets = min(MAX_BUCKETS, max(1, math.ceil(n / ROWS_PER_BUCKET)))
    if buckets == 1:
        return []
    marks = [k / buckets for k in range(1, buckets)]
    found = docs.agg(F.percentile_approx(id_col, F.lit(marks), F.lit(max(10_000, 20 * buckets))).alias("marks")).head()[0]
    return sorted(set(found or []))


def _bucket(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the value, by binary search in a literal array; null values come first."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    marks = F.lit(bounds)
    found = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(marks, at + step - 1) <= value, F.lit(False)), at + step).otherwise(at))
    return F.when(value.isNull(), F.lit(0)).otherwise(found)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """Every row's id, text and ``extra`` columns beside the next row's text and extras (``next_...``), in ascending order of id; the first row follows the last.

    Rows of equal id stand in the order of a hash of their texts. The order is cut into buckets at percentiles of the
    id; texts are shuffled once, by bucket. Each bucket's first row is also sent to the bucket before it.
    """
    extra = extra or {}
    n = docs.count()
    bounds = _bounds(docs, id_col, n)
    ids = docs.select(F.col(id_col).alias("_id")).groupBy(_bucket(F.col("_id"), bounds).alias("bucket"))
    firsts = sorted((r.bucket, r.first, r.nulls) for r in ids.agg(F.min("_id").alias("first"), F.count_if(F.col("_id").isNull()).alias("nulls")).collect())
    used = [b for b, _, _ in firsts]
    before = {b: used[i - 1] for i, b in enumerate(used)} if used else {}
    rows = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text")).withColumn("_bucket", _bucket(F.col("_id"), bounds))
    if firsts:
        slots = len(bounds) + 1
        at = {b: (None if nulls else first) for b, first, nulls in firsts}
        first_of = F.get(F.lit([at.get(b) if at.get(b) is not None else -1 for b in range(slots)]), F.col("_bucket"))
        null_first = F.get(F.lit([b in at and at[b] is None for b in range(slots)]), F.col("_bucket"))
        is_first = F.when(null_first, F.col("_id").isNull()).otherwise(F.coalesce(F.col("_id") == first_of, F.lit(False)))
        own = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("ghost"))
        ghost = F.struct(F.get(F.lit([before.get(b, 0) for b in range(slots)]), F.col("_bucket")).alias("bucket"), F.lit(1).alias("ghost"))
        rows = rows.withColumn("_at", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own))))
    else:
        rows = rows.withColumn("_at", F.struct(F.lit(0).alias("bucket"), F.lit(0).alias("ghost")))
    dealt = rows.select("_id", "_text", "_at.bucket", "_at.ghost").repartition(max(1, min(len(used), 20_000)), "bucket")
    dealt = dealt.select("*", F.xxhash64("_text").alias("_tie"), *[c.alias(k) for k, c in extra.items()])
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("_id").asc_nulls_first(), "_tie")
    names = ["_text", *extra]
    joined = dealt.select("*", *[F.lead(k).over(order).alias(f"next_{k.lstrip('_')}") for k in names])
    return joined.where("ghost = 0").select(F.col("_id").alias("doc_id"), F.col("_text").alias("text"), *extra, *[f"next_{k.lstrip('_')}" for k in names])


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last floor(n/2) code points are replaced by the first as many of the next document."""
    rows = with_next(docs, id_col, text_col, {"_tree": summary(F.col("_text"))})
    n = F.length("text")
    half = F.call_function("div", n, F.lit(2)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), "_tree", F.col("next_tree").alias("_next"),
        F.get(F.transform(F.array(edited), lambda t: F.struct(F.sha2(t.cast("binary"), 256).alias("sha256"), summary(t).alias("tree"))), F.lit(0)).alias("_edited"),
    )
    own, edited, after = F.col("_tree"), F.col("_edited.tree"), F.col("_next")
    return rows.select(
        "doc_id", "n_chars", F.col("_edited.sha256").alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"),
    )
