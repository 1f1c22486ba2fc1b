"""Similarity self-join of word shingle sets by PartEnum signatures (operator 10).

Sets of a size band can differ in k shingles at most. The domain of shingles is partitioned by a hash; with more
partitions than differences, some are equal in both sets. Where few differences leave many partitions, each is cut into
second-level parts and all subsets that leave one part out are enumerated. A signature is the hash of a set's shingles in
such a region: similar sets of a band share one, and what shares one is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import Scratch, free_shuffles, materialise, text_or_empty
from rivulet.llm.components import components

#: Up to so many differences two levels are used; second-level parts; differences for each spare partition of a single level.
TWO_LEVELS, PARTS, SPARE = 12, 3, 6
#: Partitions that a set tries whose shingles leave regions empty; rounds in which buckets meet their most connected member.
SEEDS, HUB_ROUNDS = 8, 2
#: Sets that a task remembers, to sign copies once; bytes of text in a pass.
KNOWN_SETS, PASS_BYTES = 1_000_000, 2_000_000
#: Least and most bits of the filter that tells which documents a verification needs (more documents only mean more false hits).
FILTER_BITS = 1 << 16, 1 << 27
#: Sizes up to this are classes of their own in the comparison of rare shingles; above, a class spans this factor.
SMALL, STEP = 32, 1.03

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


#: Whether a byte belongs to a word, the value that it has in a word's hash (A-Z as a-z), and the hash's base (odd, so it has an inverse).
_IN_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)], np.int8)
_VALUE = _mix((np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64) + np.uint64(1)) * _A)
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n."""
    found = np.full(n, base, np.uint64)
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every word in ``data``: differences of one polynomial's running sums, freed of their position."""
    raw = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_IN_WORD[raw], prepend=np.int8(0), append=np.int8(0)))
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    return start, _mix((sums[end] - sums[start]) * _powers(_INVERSE, len(raw) + 1)[start] + (end - start).astype(np.uint64))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles of ``width`` words; a shorter text is one shingle, one without words none."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    start, hashes = word_hashes(b"\n".join(coded))
    ends = np.searchsorted(start, np.cumsum([len(c) + 1 for c in coded])).tolist() if coded else []
    n = len(hashes)
    grams = np.zeros(n, np.uint64)
    for i in range(width):
        m = max(n - i, 0)
        grams[:m] = _mix(grams[:m] * _A + hashes[n - m :] + np.uint64(i + 1))
    sets, at = [], 0
    for end in ends:
        if 0 < end - at < width:
            whole = _C[None] + np.uint64(end - at)
            for h in hashes[at:end]:
                whole = _mix(whole * _A + h)
            sets.append(whole)
        else:
            found = np.sort(grams[at : max(at, end - width + 1)])
            sets.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found)
        at = end
    return sets


def band(size: int, percent: int) -> int:
    """The size band of a set: bands end where a similar set can be no larger."""
    low, i = 1, 0
    while True:
        high = low * 100 // percent
        if size <= high:
            return i
        low, i = high + 1, i + 1


def band_ends(percent: int, most: int) -> list[int]:
    ends = [100 // percent]
    while ends[-1] < most:
        ends.append((ends[-1] + 1) * 100 // percent)
    return ends


def differences(end: int, percent: int) -> int:
    """The most shingles in which similar sets of at most ``end`` can differ: (1 - t) / (1 + t) of both sizes."""
    return (100 - percent) * 2 * end // (100 + percent)


def _regions(shingles: np.ndarray, seed: np.uint64, n1: int, two: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of a partition's regions, whether each holds a shingle, and how many first-level partitions might be equal in empty regions only."""
    first = (_mix(shingles + seed) >> np.uint64(32)) % np.uint64(n1)
    value = _mix(shingles ^ _C)
    parts = PARTS if two else 1
    cell = (first * np.uint64(parts) + (_mix(shingles * _A + seed) % np.uint64(parts))).astype(np.int64)
    count = np.bincount(cell, minlength=n1 * parts).reshape(n1, parts)
    total = np.zeros(n1 * parts, np.uint64)
    np.add.at(total, cell, value)
    total = total.reshape(n1, parts)
    if two:  # a region leaves one part out
        count, total = count.sum(1, keepdims=True) - count, total.sum(1, keepdims=True) - total
    made = _mix(total * _A + np.arange(n1 * parts, dtype=np.uint64).reshape(n1, parts) + seed)
    return made, count > 0, int((count == 0).any(1).sum())


def signatures(shingles: np.ndarray, number: int, end: int, percent: int) -> tuple[np.ndarray, int]:
    """The set's signatures for one band, and how many of them it has in common with any similar set, at least.

    With one level there are more partitions than k, so at least ``n1 - k`` are equal in similar sets; with two levels at
    least ``n1 - k // 2`` differ in one place at most and then one enumerated subset is equal. Regions without a shingle
    say nothing and are left out. Similar sets can have only empty regions in common if so many partitions are weak in
    both, so each of them signs again by another partition, until one has few enough weak ones; only a set that never
    finds one (out of ``SEEDS``) signs its empty regions too.
    """
    k = differences(end, percent)
    seed = np.uint64((number + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
    if k == 0:
        return _mix(np.array([shingles.sum(dtype=np.uint64)], np.uint64) + seed), 1
    two = k <= TWO_LEVELS
    n1 = k // 2 + 1 if two else k + 2 + k // SPARE
    enough, found = n1 - (k // 2 if two else k), []
    for _ in range(SEEDS):
        made, filled, weak = _regions(shingles, seed, n1, two)
        found.append(made[filled])
        if weak < enough:
            return np.concatenate(found), 1 if two or len(found) > 1 else enough - weak
        seed = _mix(seed[None] + _A)[0]
    return np.concatenate([*found, made[~filled]]), 1


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in slices of bounded text, so that only so much of it is ever in Python strings."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)) // PASS_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(ends)]
        for first, last in zip(cuts, cuts[1:], strict=False):
            if last > first:
                yield batch.slice(first, last - first)


def _lists(parts: list[np.ndarray | None]) -> pa.Array:
    """array<long> of the parts; None is null."""
    ends = np.cumsum([0 if x is None else len(x) for x in parts]).tolist()
    offsets = [None if x is None else end - len(x) for x, end in zip(parts, ends, strict=True)]
    values = np.concatenate([x.view(np.int64) for x in parts if x is not None] or [np.zeros(0, np.int64)])
    return pa.ListArray.from_arrays(pa.array([*offsets, len(values)], pa.int32()), pa.array(values))


def _members(rows: DataFrame, width: int) -> DataFrame:
    """Per row doc_id, text_hash, set_id, n_shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _passes(batches):
            sets = shingle_sets(part.column("text").to_pylist(), width)
            columns = [part.column("doc_id"), part.column("text_hash"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "set_id", "n_shingles"])

    return rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id string, text_hash long, set_id long, n_shingles long")


def _signed(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """Per set, once in a task, and for each of its two bands: id, meta and signatures (array<long>). They go straight to the shuffle; as a table they would be larger than the texts.

    ``meta`` packs the number of shingles, the least number of signatures in common with a similar set, and which band it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, seen = band_ends(percent, 1000), set()
        for part in _passes(batches):
            keys, metas, made = [], [], []
            for shingles in shingle_sets(part.column("text").to_pylist(), width):
                n, key = len(shingles), set_id(shingles)
                if not n or key in seen:
                    continue
                if len(seen) >= KNOWN_SETS:
                    seen.clear()
                seen.add(key)
                if ends[-1] < n:
                    ends = band_ends(percent, n)
                i = int(np.searchsorted(ends, n))
                for which, end in enumerate((ends[i], (ends[i] + 1) * 100 // percent)):
                    found, least = signatures(shingles, i + which, end, percent)
                    keys.append(key)
                    metas.append(n << 17 | min(least, 0xFFFF) << 1 | which)
                    made.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(metas, pa.int64()), _lists(made)], ["id", "meta", "signatures"])

    return rows.select("text").mapInArrow(run, "id long, meta long, signatures array<long>")


def _needed_sets(rows: DataFrame, members: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles) of the wanted sets, computed again from the texts that a filter of bounded size lets through."""
    ids = members.join(wanted, "set_id", "left_semi").groupBy("set_id").agg(F.min(F.xxhash64("doc_id")).alias("h"))
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * wanted.count()).bit_length()))
    ids = ids.select(F.pmod("h", F.lit(size)).alias("bit"))
    marked = ids.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    words = np.zeros(size // 64, np.uint64)
    for row in marked.toLocalIterator():
        words[row.word] = row.bits & 0xFFFFFFFFFFFFFFFF
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _passes(batches):
            at = part.column("h").to_numpy() % size
            part = part.filter(pa.array((shared.value[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) > 0))
            sets = {set_id(s): s for s in shingle_sets(part.column("text").to_pylist(), width) if len(s)}
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), _lists(list(sets.values()))], ["set_id", "shingles"])

    found = rows.select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(run, "set_id long, shingles array<long>")
    return found.join(wanted, "set_id", "left_semi").dropDuplicates(["set_id"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity is at least percent / 100, exactly. A hub stands in ``a``, so the rows that meet its set are small."""
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("common"), (F.size("x") + F.size("y") - common).alias("all"))
    return both.where(F.col("common") * 100 >= F.col("all") * percent).select("a", "b")


def _several(rest: DataFrame) -> DataFrame:
    """The rows of buckets that hold several components. Minima per bucket come before the join, so a hot bucket is no group of one task."""
    several = rest.groupBy("sig").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low != _high").select("sig")
    return rest.join(several, "sig", "left_semi")


def _open(scratch: Scratch, rest: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their labels, that can still hold a link between components.

    A set that shares fewer signatures of a band with other components than similar sets must leaves that band, whereupon
    its buckets hold fewer; this goes on while it takes away much. Documents that share a passage only part here.
    """
    known = labels.select(F.col("node").alias("id"), "label")
    rest = scratch.table(_several(rest.drop("label").join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))))
    left = rest.count()
    while left:
        bands = rest.groupBy("id", "meta").agg(F.count("*").alias("_shared")).where((F.col("_shared") >= F.shiftright("meta", 1).bitwiseAND(0xFFFF)))
        rest = scratch.table(_several(rest.join(bands.drop("_shared"), ["id", "meta"], "left_semi")))
        before, left = left, rest.count()
        if left > 0.9 * before:
            break
    free_shuffles(rest.sparkSession)
    return rest


def _hub_pairs(rest: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Each set with the most connected member of other components that is the hub of one of its buckets and was not tried."""
    degree = rest.groupBy("id").agg(F.count("*").alias("degree"))  # a family's common ancestor stands in more shared buckets than its offspring
    heads = rest.join(degree, "id").groupBy("sig").agg(F.max(F.struct("degree", F.col("id").alias("a"), F.col("n").alias("m"), F.col("label").alias("of"))).alias("hub"))
    met = rest.join(heads, "sig").where("label != hub.of").where(F.least("n", "hub.m") * 100 >= F.greatest("n", "hub.m") * percent)
    pairs = met.select(F.col("hub.a").alias("a"), F.col("id").alias("b"), "hub.degree").distinct()
    either = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = pairs.join(either, ["a", "b"], "left_anti").groupBy("b").agg(F.max(F.struct("degree", "a")).alias("best"))
    return best.select("best.a", "b")


def _over(x: Column, y: int) -> Column:
    """x / y, rounded up, in whole numbers."""
    return F.call_function("div", x + (y - 1), F.lit(y))


def _size_class(n: Column) -> Column:
    return F.when(n <= SMALL, n).otherwise(SMALL + F.floor(F.log(n / SMALL) / math.log(STEP))).cast("int")


def _rare_pairs(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share a signature and a shingle among the rarest of both.

    Similar sets of sizes n and m have at least o = t / (1 + t) * (n + m) shingles in common, so in any order of all
    shingles they meet within the first n - o + 1 of one and m - o + 1 of the other. Shingles that one component alone
    has come first and meet nothing; then the rarest. Copies with many edits of their own therefore leave at once. One
    join key is a shingle with the classes of both sizes, as these settle how far to look.
    """
    known = rest.groupBy("id").agg(F.first("n").alias("n"), F.first("label").alias("label"), F.collect_set("sig").alias("sigs"))
    here = known.select(F.col("id").alias("set_id"), "n", "label").join(sets, "set_id").select("set_id", "n", "label", F.explode("shingles").alias("shingle"))
    common = here.groupBy("shingle").agg(F.count("*").alias("df"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low != _high").select("shingle", "df")
    mine = Window.partitionBy("set_id")
    place = F.col("n") - F.count("*").over(mine) + F.row_number().over(mine.orderBy("df", "shingle"))  # from 1
    placed = here.join(common, "shingle").withColumn("place", place)
    n, t = F.col("n"), percent
    placed = placed.where(F.col("place") <= n - _over(n * t, 100) + 1).withColumn("own", _size_class(n))
    placed = placed.withColumn("other", F.explode(F.sequence(_size_class(_over(n * t, 100)), _size_class(_over(n * 100, t)))))
    least = F.when(F.col("other") <= SMALL, F.col("other")).otherwise(F.floor(SMALL * F.pow(F.lit(STEP), F.col("other") - SMALL)) - 1)
    placed = placed.where(F.col("place") <= n - _over((n + least.cast("long")) * t, 100 + t) + 1)
    keyed = placed.select("shingle", F.least("own", "other").alias("c"), F.greatest("own", "other").alias("d"), "set_id", "n", "label", "place")
    # members of the largest component at a shingle don't meet each other
    sizes = keyed.groupBy("shingle", "label").agg(F.count("*").alias("_size")).groupBy("shingle").agg(F.max_by("label", F.struct("_size", "label")).alias("major"))
    keyed = keyed.join(sizes, "shingle").withColumn("minor", F.col("label") != F.col("major"))
    x, y = (keyed.select("shingle", "c", "d", *[F.col(k).alias(f"{k}_{side}") for k in ("set_id", "n", "label", "place", "minor")]) for side in "ab")
    least = _over((F.col("n_a") + F.col("n_b")) * t, 100 + t)
    met = x.where("minor_a").join(y, ["shingle", "c", "d"]).where("label_a != label_b and (set_id_a < set_id_b or not minor_b)")
    met = met.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * t) & (F.col("place_a") + least <= F.col("n_a") + 1) & (F.col("place_b") + least <= F.col("n_b") + 1))
    pairs = met.select(F.least("set_id_a", "set_id_b").alias("a"), F.greatest("set_id_a", "set_id_b").alias("b")).distinct()
    signed = [known.select(F.col("id").alias(side), F.col("sigs").alias(f"s{side}")) for side in "ab"]
    return pairs.join(signed[0], "a").join(signed[1], "b").where(F.arrays_overlap("sa", "sb")).select("a", "b")


def _labelled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, set_id, n_shingles) of ``docs`` and, per set that has links, set_id and label, the smallest set_id of its component.

    Rows of equal sets are one class (set_id); only classes are joined. Sets that share too few signatures with others
    leave first. The others are compared with the most connected members of their buckets that are still apart from
    them; these comparisons are as many as members. Buckets that then hold several components compare those of their
    members that have a rare shingle in common. So no link that could join components is lost, while copies, families of near copies and their
    too distant relatives cost a few comparisons a member. Sets are compared by 64-bit shingle hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    every = materialise(_members(rows, width))
    members = every.where("n_shingles > 0")
    with Scratch(spark) as scratch:
        exploded = _signed(rows, width, percent).select(F.explode("signatures").alias("sig"), "id", "meta")
        bucket = Window.partitionBy("sig")
        buckets = exploded.select("*", F.min("id").over(bucket).alias("_low"), F.max("id").over(bucket).alias("_high")).where("_low != _high")
        # most signatures stand alone and are gone before copies of other tasks are left out
        rest = scratch.table(buckets.select("sig", "id", "meta", F.shiftright("meta", 17).alias("n")).distinct())
        del exploded, buckets
        free_shuffles(spark)
        links = tried = spark.createDataFrame([], "a long, b long")
        labels, sets = spark.createDataFrame([], "node long, label long"), None  # outlives the scratch tables if nothing is linked
        for step in range(HUB_ROUNDS + 1):
            rest = _open(scratch, rest, labels)
            if rest.isEmpty():
                break
            if sets is None:  # those of all candidates are computed once
                sets = scratch.table(_needed_sets(rows, members, scratch.table(rest.select(F.col("id").alias("set_id")).distinct()), width))
                free_shuffles(spark)
            pairs = scratch.table(_hub_pairs(rest, tried, percent) if step < HUB_ROUNDS else _rare_pairs(rest, sets, percent))
            found = scratch.table(_verified(pairs, sets, percent))
            tried, links = tried.unionByName(pairs), links.unionByName(found)
            if not found.isEmpty():
                labels = components(links)
    return every, labels.select(F.col("node").alias("set_id"), "label")


def join_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, set_id, n_shingles and component_id, the smallest doc_id reachable by links.

    A null or empty text, or one of white space, has no set, links with nothing and is its own component (its own id).
    Null ids take part and never name a component that has another; repeated ids and rows stay; other columns are not read.
    """
    every, labels = _labelled(docs, width, percent, id_col, text_col)
    smallest = every.where("n_shingles > 0").groupBy("set_id").agg(F.min(F.col("doc_id").cast("long")).alias("least"))
    named = smallest.join(labels, "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    heads = named.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = named.join(heads, "label").select("set_id", "component_id")
    joined = every.join(classes, "set_id", "left")
    own = F.col("doc_id").cast("long")
    return joined.select(own.alias("doc_id"), "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", own)).otherwise(own).alias("component_id"), "set_id")


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay when each component keeps one row: that of its smallest id, nulls last.

    Components are told by their texts, so rows that repeat an id and are no near copies all stay. A row without a set
    stays; of those that repeat an id one does.
    """
    every, labels = _labelled(docs, width, percent, id_col, text_col)
    own = F.col("doc_id").cast("long")
    rank = F.struct(own.isNull().alias("no_id"), own.alias("doc_id"), "set_id", "text_hash")
    # a minimum per set comes first, so that copies meet no join
    heads = every.where("n_shingles > 0").groupBy("set_id").agg(F.min(rank).alias("head"))
    heads = heads.join(labels, "set_id", "left").groupBy(F.coalesce("label", "set_id").alias("label")).agg(F.min("head").alias("head"))
    bare = every.where("n_shingles = 0").select(own.alias("doc_id"), "text_hash")
    bare = bare.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash", F.lit(False).alias("all")).unionByName(bare.where("doc_id is null").distinct().withColumn("all", F.lit(True)))
    kept = materialise(heads.select("head.doc_id", "head.text_hash", F.lit(False).alias("all")).unionByName(bare))
    names, key, text_hash = docs.columns, F.col("_row")[id_col].cast("long"), F.xxhash64(F.coalesce(F.col("_row")[text_col], F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    rows = rows.select("_row", key.alias("_id"), text_hash.alias("_hash")).join(kept, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).drop("doc_id", "text_hash")
    if not every.groupBy(own, "text_hash").count().where("count > 1").isEmpty():
        first = Window.partitionBy("_id", "_hash").orderBy(F.xxhash64("_row"))
        rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1 or all")
    return rows.select("_row.*")
