"""Ranked lexical search over document shards (operator 11).

Every task packs the documents it reads into shards: postings in compressed sparse rows (terms, starts, document places)
with an integer impact for each posting, computed once from the collection's totals. A block of queries is scored shard by
shard, term at a time, into one dense accumulator; the best of a shard are picked by argpartition, ties to the smaller id,
and merged by task and then by query. Shards hold a bounded number of characters, tasks a bounded number of shards.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialise, text_or_empty

#: Characters of a shard (a longer document has one of its own) and of the query texts of one broadcast block.
SHARD_CHARS, BLOCK_CHARS = 8_000_000, 8_000_000
#: A term: the longest run without ASCII characters other than letters and digits.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Parts of the length normalisation and of the saturation.
BASE, SLOPE, SCALE, SATURATION = 100, 25, 1_000_000_000, 12

#: Bytes of a text as they count: A-Z lower-cased, what parts terms as a space.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_INDEX = "terms binary, starts binary, places binary, impacts binary, ids binary, unknown binary"


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERM_BYTES).split()


def totals(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """How many documents have a term, and how many terms they have in all."""
    n = docs.select(F.regexp_count(text_or_empty(text_col), F.lit(TERM)).cast("long").alias("n"))
    row = n.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()
    return row[0], row[1]


class _Places(dict):
    def __missing__(self, term: bytes) -> int:
        found = self[term] = len(self)
        return found


def pack_shard(ids: np.ndarray, unknown: np.ndarray, texts: list[str], docs: int, terms: int) -> tuple:
    """The postings of some documents. Places follow ascending ids, null ids (``unknown``) last."""
    known = _Places()
    order = np.lexsort((ids, unknown))
    runs = [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in (terms_of(texts[i]) for i in order)]
    n = np.array([len(r) for r in runs], np.int64)
    posting, tf = np.unique(np.concatenate(runs) * len(order) + np.repeat(np.arange(len(order)), n), return_counts=True)
    term, place = posting // len(order), posting % len(order)
    norm = BASE - SLOPE + SLOPE * n * docs // max(terms, 1)
    impacts = SCALE * tf // (1_000 * tf + SATURATION * norm[place])
    starts = np.searchsorted(term, np.arange(len(known) + 1))
    return b" ".join(known), starts.astype(np.int32).tobytes(), place.astype(np.int32).tobytes(), impacts.astype(np.int32).tobytes(), ids[order].tobytes(), unknown[order].tobytes()


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The index as a table of shards, and the number of documents with terms. A null text has no terms; rows that repeat an id count each."""
    n, all_terms = totals(docs, text_col)
    of = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(of, F.lit(0)).alias("id"), of.isNull().alias("unknown"), text_or_empty(text_col).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            chars = batch.text.str.len().to_numpy()
            group = (size + chars.cumsum() - chars) // SHARD_CHARS
            for at in np.unique(group):
                if at and held:
                    yield packed(held)
                    held, size = [], 0
                held.append(batch[group == at])
                size += int(chars[group == at].sum())
        if held:
            yield packed(held)

    def packed(held: list[pd.DataFrame]) -> pd.DataFrame:
        x = pd.concat(held)
        shard = pack_shard(x.id.to_numpy(np.int64), x.unknown.to_numpy(bool), x.text.tolist(), n, all_terms)
        return pd.DataFrame([shard], columns=[c.split()[0] for c in _INDEX.split(", ")])

    return materialise(rows.mapInPandas(run, _INDEX)), n


class Block:
    """Some queries: their ids and, for each, its terms' numbers and how often each is asked for."""

    def __init__(self, ids: list, texts: list[str]):
        places = _Places()
        self.ids, self.asked = ids, [[(places[t], n) for t, n in Counter(terms_of(text)).items()] for text in texts]
        self.terms: list[bytes] = list(places)
        self.weights = np.zeros(len(places), np.int64)

    def weigh(self, frequency: dict[bytes, int], docs: int) -> None:
        self.weights = np.array([math.floor(1_000 * math.log((2 * docs + 2) / (2 * frequency.get(t, 0) + 1))) for t in self.terms], np.int64)


def _frequencies(index: DataFrame, block: Broadcast) -> dict[bytes, int]:
    """In how many documents each term of the block occurs; reads no postings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, total = set(block.value.terms), Counter()
        for batch in batches:
            for terms, starts in zip(batch.terms, batch.starts, strict=True):
                n = np.diff(np.frombuffer(starts, np.int32)).tolist()
                total.update({t: n[i] for i, t in enumerate(terms.split(b" ")) if t in wanted})
        if total:
            yield pd.DataFrame({"term": list(total.keys()), "n": list(total.values())})

    found = index.select("terms", "starts").mapInPandas(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r.term): r.n for r in found.collect()}  # at most the terms of the block


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, highest first, ties to the smaller place; all, if fewer."""
    least = 1
    if len(scores) > k:
        least = max(1, scores[np.argpartition(scores, len(scores) - k)[len(scores) - k]])
    at = np.flatnonzero(scores >= least)  # every place that ties with the last is in
    return at[np.lexsort((at, -scores[at]))][:k]


def _scored(index: DataFrame, block: Broadcast, k: int) -> DataFrame:
    """The k best documents of each task for each query of the block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries: Block = block.value
        top: dict[int, tuple] = {}
        for batch in batches:
            for shard in batch.itertuples(index=False):
                place = {t: i for i, t in enumerate(shard.terms.split(b" "))}
                starts, places, impacts = (np.frombuffer(x, np.int32) for x in (shard.starts, shard.places, shard.impacts))
                ids, unknown = np.frombuffer(shard.ids, np.int64), np.frombuffer(shard.unknown, bool)
                at = [place.get(t, -1) for t in queries.terms]
                scores = np.zeros(len(ids), np.int64)
                for q, asked in enumerate(queries.asked):
                    scores[:] = 0
                    for term, times in asked:
                        if (i := at[term]) >= 0:
                            part = slice(starts[i], starts[i + 1])
                            scores[places[part]] += impacts[part] * (queries.weights[term] * times)
                    found = best(scores, k)
                    if len(found):
                        new = (scores[found], ids[found], unknown[found])
                        merged = [np.concatenate(x) for x in zip(top[q], new, strict=True)] if q in top else new
                        order = np.lexsort((merged[1], merged[2], -merged[0]))[:k]
                        top[q] = tuple(x[order] for x in merged)
        rows = [(q, queries.ids[q], None if null else int(i), int(s)) for q, found in top.items() for s, i, null in zip(*found, strict=True)]
        if rows:
            yield pd.DataFrame(rows, columns=["query", "item_id", "doc_id", "score"]).astype({"item_id": "Int64", "doc_id": "Int64"})

    return index.mapInPandas(run, "query long, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The k documents of the highest scores above 0 for every item: item_id, rank (from 1), doc_id, score.

    Equal scores go by ascending doc_id, a null doc_id last; rows that repeat an id are ranked each. Items that repeat id
    and text are one; items of one id with different texts are ranked each by itself. A null or termless text finds
    nothing. Items go out in blocks of bounded size; each block reads the index once.
    """
    spark = docs.sparkSession
    index, n = build(docs, id_col, text_col)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), text_or_empty(item_text_col).alias("text")).distinct()
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    blocks, parts = max(1, math.ceil(size / BLOCK_CHARS)), []
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).collect()
        block = Block([r.item_id for r in rows], [r.text for r in rows])
        block.weigh(_frequencies(index, spark.sparkContext.broadcast(block)), n)
        parts.append(_scored(index, spark.sparkContext.broadcast(block), k).withColumn("block", F.lit(number)))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    by_query = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: The same ranking as one statement over the tables documents and benchmark.
ORACLE = """
WITH docs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), lengths AS (SELECT doc_id, count(*) AS n FROM docs GROUP BY doc_id
), everything AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths
), postings AS (SELECT term, doc_id, count(*) AS tf FROM docs GROUP BY term, doc_id
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(everything.docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, everything GROUP BY term
), scores AS (
  SELECT item_id, p.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * everything.docs) // everything.terms)))) AS BIGINT) AS score
  FROM items JOIN postings p USING (term) JOIN weights USING (term) JOIN lengths ON lengths.doc_id = p.doc_id, everything
  GROUP BY item_id, p.doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
