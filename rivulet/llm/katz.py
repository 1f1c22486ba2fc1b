"""Language-model scoring by Katz backoff (operator 3).

Bigrams with Good-Turing discounts back off to discounted unigrams, these to one class of unknown words; backoff weights
are the exact remainder of each history, so every distribution over the V known tokens and the unknown one sums to 1.

Counting and scoring share one shuffle. Every pass over some documents packs its bigram occurrences into one blob for
each bucket of histories (dictionaries of 64-bit word hashes and small indices). A bucket holds all that follows its
histories: it counts the training part, asks the buckets of the following words for their unigram counts, and scores all
occurrences; sums of logarithms return by document. No table of words, bigrams or documents is in one place.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import held_out, text_or_empty

#: Documents whose occurrences share a bucket's task, on average; counts that are discounted; characters tokenised at a time.
DOCS_PER_BUCKET, DISCOUNTED, PASS_CHARS = 6_000, 5, 4_000_000
#: Hashes that stand for a text's begin (only a history) and end (a token).
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STATS = ("n", "v", *[f"u{r}" for r in range(1, DISCOUNTED + 2)], *[f"b{r}" for r in range(1, DISCOUNTED + 2)])


def _pack(*what) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(what, protocol=5))


def _unpack(blob: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65_536 else np.uint32)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a token as a history; the end has the bucket of the begin, which counts as many."""
    at = np.where(hashes == END, BEGIN, hashes)
    return ((at * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % buckets


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _tokens(texts: list[str], ids: _Ids) -> tuple[np.ndarray, np.ndarray]:
    found, counts = [], []
    for text in texts:
        words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        counts.append(len(words))
        found.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
    return np.concatenate(found) if found else np.zeros(0, np.int32), np.array(counts, np.int64)


def _emit(buckets: int):
    """Packs a batch of documents: a blob of bigram occurrences for each bucket, and one of the documents themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() * 1_000_000
        for batch in batches:
            group = batch.text.str.len().to_numpy().cumsum() // (16 * PASS_CHARS)
            for _, rows in batch.groupby(group):
                yield pd.DataFrame(_blobs(rows, chunk, buckets), columns=["bucket", "chunk", "blob"])
                chunk += 1

    return run


def _blobs(rows: pd.DataFrame, chunk: int, buckets: int) -> list[tuple]:
    ids = _Ids()
    tokens, counts = _tokens(rows.text.tolist(), ids)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in ids] + [int(BEGIN), int(END)], np.uint64)
    begin, end = len(ids), len(ids) + 1
    # every document as begin, words, end
    at = np.cumsum(counts + 2) - counts - 2
    line = np.empty(int((counts + 2).sum()), np.int32)
    inner = np.ones(len(line), bool)
    inner[at], inner[at + counts + 1] = False, False
    line[inner], line[at], line[at + counts + 1] = tokens, begin, end
    owner = np.repeat(np.arange(len(rows)), counts + 2)
    last = np.zeros(len(line), bool)
    last[at + counts + 1] = True
    left, right, owner = line[:-1][~last[:-1]], line[1:][~last[:-1]], owner[:-1][~last[:-1]]
    to = _bucket_of(hashes, buckets)[left].astype(np.int32)
    order = np.argsort(to.astype(np.uint16) if buckets < 65_536 else to, kind="stable")
    left, right, owner, to = left[order], right[order], owner[order], to[order]
    cuts = np.searchsorted(to, np.arange(buckets + 1))
    train = rows.train.to_numpy()
    out = [(buckets + chunk % buckets, chunk, _pack(rows.doc_id.tolist(), train, counts + 1))]
    slot = np.zeros(len(hashes), np.int32)
    for b in range(buckets):
        part = slice(cuts[b], cuts[b + 1])
        if cuts[b] == cuts[b + 1]:
            continue
        coded = []
        for side in (left[part], right[part]):
            used = np.flatnonzero(np.bincount(side, minlength=len(hashes)))
            used = used[np.argsort(hashes[used])]
            slot[used] = np.arange(len(used))
            coded += [hashes[used], _narrow(slot[side])]
        docs, runs = np.unique(owner[part], return_counts=True)
        out.append((b, chunk, _pack(*coded, _narrow(docs), _narrow(runs), train[docs])))
    return out


@dataclass
class _Counts:
    """Training bigrams of a bucket in the order of their hashes, and where each history begins."""

    left: np.ndarray
    right: np.ndarray
    count: np.ndarray
    histories: np.ndarray
    first: np.ndarray

    @property
    def totals(self) -> np.ndarray:
        return np.add.reduceat(self.count, self.first) if len(self.first) else np.zeros(0, np.int64)


def _occurrences(blob: bytes):
    """left hashes, left index, right hashes, right index, document index, whether it is for training."""
    h1, i1, h2, i2, docs, runs, train = _unpack(blob)
    return h1, i1.astype(np.int64), h2, i2.astype(np.int64), np.repeat(docs.astype(np.int64), runs), np.repeat(train, runs)


def _merge(left: list, right: list, count: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b, c = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((left, np.uint64), (right, np.uint64), (count, np.int64)))
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], np.add.reduceat(c, at) if len(at) else c


def _counted(blobs: list[bytes]) -> tuple[_Counts, np.ndarray]:
    """The training counts of a bucket, and all right hashes that occur."""
    left, right, count, seen = [], [], [], []
    for blob in blobs:
        h1, i1, h2, i2, _, train = _occurrences(blob)
        pairs, n = np.unique(i1[train] * len(h2) + i2[train], return_counts=True)
        left.append(h1[pairs // max(len(h2), 1)])
        right.append(h2[pairs % max(len(h2), 1)])
        count.append(n)
        seen.append(h2)
    a, b, c = _merge(left, right, count)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    first = np.flatnonzero(new)
    return _Counts(a, b, c, a[first], first), np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)


def _unigrams(counts: _Counts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and counts of a bucket: a word is a history as often as it occurs; the end occurs as often as the begin."""
    keys = np.where(counts.histories == BEGIN, END, counts.histories)
    order = np.argsort(keys)
    return keys[order], counts.totals[order]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of the wanted keys in sorted ``keys``, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def discounts(of: list[int]) -> np.ndarray:
    """Good-Turing discount ratios of the counts 1 to DISCOUNTED from their counts of counts; 1 above.

    Where counts of counts give no ratio between 0 and 1 (small or odd corpora), a count loses a half instead.
    """
    k, ratio = DISCOUNTED, np.ones(DISCOUNTED + 1)
    n = [0, *of]
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for r in range(1, k + 1):
        turing = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        found = (turing - common) / (1 - common) if common < 1 else 0.0
        ratio[r] = found if 0.01 < found < 1 else (r - 0.5) / r
    return ratio


def _discounted(count: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    return count * np.where(count <= DISCOUNTED, ratio[np.minimum(count, DISCOUNTED)], 1.0)


@dataclass
class _Unigram:
    total: int
    kinds: int
    ratio: np.ndarray
    unknown: float

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, _discounted(count, self.ratio) / max(self.total, 1), self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.total + self.kinds + 1))


def _unigram(stats) -> _Unigram:
    of = [int(stats[f"u{r}"]) for r in range(1, DISCOUNTED + 2)]
    ratio, n = discounts(of), int(stats["n"])
    lost = sum((1 - ratio[r]) * r * of[r - 1] for r in range(1, DISCOUNTED + 1))
    if n and lost <= 0:  # no rare token: a half of one token is left to unknown ones
        ratio, lost = ratio * (n - 0.5) / n, 0.5
        model = _Unigram(n, int(stats["v"]), ratio, 0.5 / n)
        model.p = lambda c, n=n: np.where(c > 0, c * (n - 0.5) / n / n, 0.5 / n)
        return model
    return _Unigram(n, int(stats["v"]), ratio, lost / n if n else 1.0)


def backoff(counts: _Counts, p_right: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the seen bigrams and the weight of each history, such that each history sums to 1 exactly."""
    if not len(counts.first):
        return np.zeros(0), np.zeros(0)
    sizes = np.diff(np.append(counts.first, len(counts.left)))
    p = _discounted(counts.count, ratio) / np.repeat(counts.totals, sizes)
    seen, low = np.add.reduceat(p, counts.first), np.add.reduceat(p_right, counts.first)
    full = 1 - seen < 1e-9  # only counts above the discounted ones: one more count is left over
    p = p * np.repeat(np.where(full, counts.totals / (counts.totals + 1), 1.0), sizes)
    seen = np.add.reduceat(p, counts.first)
    rest = 1 - low
    nothing = rest < 1e-12  # every token has followed
    p = p / np.repeat(np.where(nothing, seen, 1.0), sizes)
    return p, np.where(nothing, 0.0, (1 - seen) / np.where(nothing, 1.0, rest))


def _first(key, rows: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """A bucket's statistics, its unigram counts, and its questions to the buckets of the words that follow."""
    bucket, out = int(key[0]), []
    if bucket < buckets:
        counts, right = _counted(rows.blob.tolist())
        tokens, totals = _unigrams(counts)
        of = lambda c: np.bincount(np.minimum(c, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2].tolist()
        stats = [int(totals.sum()), len(tokens), *of(totals), *of(counts.count)]
        out.append((bucket, "counts", bucket, _pack(tokens, _narrow(totals)), stats))
        to = _bucket_of(right, buckets)
        out += [(int(b), "ask", bucket, _pack(right[to == b]), None) for b in np.unique(to)]
    return pd.DataFrame(out, columns=["to", "kind", "origin", "blob", "stats"])


def _answer(key, rows: pd.DataFrame) -> pd.DataFrame:
    mine = rows[rows.kind == "counts"]
    tokens, totals = _unpack(mine.blob.iloc[0]) if len(mine) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    asked = [(o, _unpack(b)[0]) for k, o, b in zip(rows.kind, rows.origin, rows.blob, strict=True) if k == "ask"]
    return pd.DataFrame([(o, _pack(w, _narrow(_find(tokens, totals.astype(np.int64), w)))) for o, w in asked], columns=["bucket", "blob"])


def _score(key, rows: pd.DataFrame, answers: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Sums per document of a bucket's occurrences: index, log10 probability, base log10 probability, known tokens."""
    if int(key[0]) >= buckets:
        return pd.DataFrame({"chunk": rows.chunk, "kind": "docs", "blob": rows.blob})
    stats = dict(zip(_STATS, answers.stats.iloc[0], strict=True))
    low, ratio = _unigram(stats), discounts([int(stats[f"b{r}"]) for r in range(1, DISCOUNTED + 2)])
    told = [_unpack(b) for b in answers.blob]
    words, known = np.concatenate([w for w, _ in told]), np.concatenate([c.astype(np.int64) for _, c in told])
    order = np.argsort(words)
    words, known = words[order], known[order]
    p_word = low.p(known)
    counts, _ = _counted(rows.blob.tolist())
    right = np.searchsorted(words, counts.right)
    p, weight = backoff(counts, p_word[right] if len(words) else np.zeros(0), ratio)
    table = np.repeat(np.arange(len(counts.histories)), np.diff(np.append(counts.first, len(counts.left)))) * len(words) + right
    totals, out = counts.totals, []
    with np.errstate(divide="ignore"):
        log_p, log_weight, log_word = np.log10(p), np.log10(weight), np.log10(p_word)
    for chunk, blob in zip(rows.chunk, rows.blob, strict=True):
        h1, i1, h2, i2, doc, _ = _occurrences(blob)
        history = np.minimum(np.searchsorted(counts.histories, h1), max(len(counts.histories) - 1, 0))
        there = counts.histories[history] == h1 if len(counts.histories) else np.zeros(len(h1), bool)
        word = np.searchsorted(words, h2)
        wanted = history[i1] * len(words) + word[i2]
        at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
        seen = there[i1] & (table[at] == wanted) if len(table) else np.zeros(len(i1), bool)
        back = np.where(there[i1], log_weight[history[i1]], 0.0) if len(counts.histories) else np.zeros(len(i1))
        logs = np.where(seen, log_p[at], back + log_word[word[i2]]) if len(table) else log_word[word[i2]]
        c = np.where(there, totals[history], 0) if len(counts.histories) else np.zeros(len(h1), np.int64)
        docs, slot = np.unique(doc, return_inverse=True)
        sums = [np.bincount(slot, x, len(docs)) for x in (logs, low.base(c)[i1], (c > 0)[i1])]
        out.append((chunk, "sums", _pack(_narrow(docs), sums[0], sums[1], _narrow(sums[2].astype(np.int64)), low.total)))
    return pd.DataFrame(out, columns=["chunk", "kind", "blob"])


def _finish(key, rows: pd.DataFrame) -> pd.DataFrame:
    ids, train, n_tokens = _unpack(rows.blob[rows.kind == "docs"].iloc[0])
    score, base, known, total = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64), 0
    for blob in rows.blob[rows.kind == "sums"]:
        docs, s, b, k, total = _unpack(blob)
        score[docs] += s
        base[docs] += b
        known[docs] += k
    return pd.DataFrame({"doc_id": ids, "train": train, "n_tokens": n_tokens, "n_known": known, "train_tokens": total, "base_score": base, "score": score})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Learns from the rows whose crc32 of the id leaves another remainder, and scores every whole text.

    Per row: doc_id, held_out, n_tokens (words and one end), n_known (tokens that training has), train_tokens,
    base_score (add-one unigrams) and score (log10 probability). A null text counts as empty and has its end only;
    a null id counts as the text '' for the fold; repeated rows count each; an empty table gives no rows.
    A history's followers meet in one bucket, packed to a few bytes an occurrence; hot histories are counted per blob first.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"), (~held_out(id_col, modulus, remainder)).alias("train"))
    buckets = max(16, -(-docs.count() // DOCS_PER_BUCKET))
    packed = rows.mapInPandas(_emit(buckets), "bucket int, chunk long, blob binary")
    stats_type = "array<long>"
    told = packed.groupBy("bucket").applyInPandas(lambda key, x: _first(key, x, buckets), f"to int, kind string, origin int, blob binary, stats {stats_type}")
    sums = told.where("stats is not null").agg(*[F.sum(F.get("stats", F.lit(i))).alias(s) for i, s in enumerate(_STATS)])
    sums = sums.select(F.lit(1).alias("one"), F.array(*[F.coalesce(s, F.lit(0)) for s in _STATS]).alias("stats"))
    answers = told.select("to", "kind", "origin", "blob").groupBy("to").applyInPandas(_answer, "bucket int, blob binary")
    answers = answers.withColumn("one", F.lit(1)).join(F.broadcast(sums), "one").select("bucket", "blob", "stats")  # one row of 14 sums
    scored = packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(lambda key, x, y: _score(key, x, y, buckets), "chunk long, kind string, blob binary")
    done = scored.groupBy("chunk").applyInPandas(_finish, "doc_id string, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return done.select(F.col("doc_id").cast("long").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
