"""Spelling variants: words one edit apart, and the frequent form that each leads to (operator 13).

Words are counted where the documents lie. Two words of one edit agree outside one third of their letters (the shorter
word's; places are told from both ends), so each word joins a group for every third it leaves out, as the shorter or the
longer of a pair. Groups above a size are split by the letter left out, which bounds them by the alphabet. In each
bucket of groups an inverted index of positional letter pairs is merged: a probe's postings, limited to the lengths and
places that one edit allows, are merged by sorting, and candidates whose count reaches the overlap that one edit leaves
are verified. Counts and best forms are combined per word before they are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import materialise, text_or_empty

#: Least letters and occurrences of a word; how many times as frequent a form must be.
LETTERS, OCCURRENCES, TIMES = 5, 3, 2
#: Parts of a word, members of a group before it is split by letters (of parts of more letters, by so many pieces), rows of a bucket on average, pairs of members merged at a time, words that a task counts at a time.
PARTS, MEMBERS, STEPS, BUCKET, MERGED, HELD = 3, 1_000, 32, 20_000, 1_000_000, 500_000
#: One of so many runs loses a letter.
DELETED = 97

#: A Latin-1 byte as it counts: A-Z lower-cased, letters of A-Z, a-z and U+00C0 to U+00FF kept, all else a space.
_LETTER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_ROW = ["key", "m", "part", "low", "high", "begin", "end", "word", "n"]


def runs_of(text: str) -> list[bytes]:
    """Runs of letters, A-Z lower-cased, a Latin-1 byte for each letter."""
    return text.encode("latin-1", "replace").translate(_LETTER).split()


def spelt(doc_id: str, run: bytes, deleted: int = DELETED) -> bytes:
    """The run as it is read in this document: one of ``deleted`` loses a letter, by the checksum of id and run."""
    h = zlib.crc32(f"{doc_id}:{run.decode('latin-1')}".encode())
    return run if h % deleted else run[: h % len(run)] + run[h % len(run) + 1 :]


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of all words with enough letters and occurrences over all documents. Null texts have none; a null id counts as ''."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.id, batch.text, strict=True):
                before = zlib.crc32(f"{doc_id}:".encode())
                for w, n in Counter(runs_of(text)).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), before)
                    if h % DELETED == 0:
                        w = w[: h % len(w)] + w[h % len(w) + 1 :]
                    if len(w) >= LETTERS:
                        total[w] += n
                if len(total) > HELD:
                    yield counted(total)
                    total.clear()
        if total:
            yield counted(total)

    def counted(total: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": [w.decode("latin-1") for w in total], "n": list(total.values())}).astype({"n": "int64"})

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _grouped(words: DataFrame) -> DataFrame:
    """A row for each word and group: m (letters of the shorter word), the third, its bounds in the shorter word, and those of what is left out."""
    length = F.length("word")
    both = words.select("*", F.explode(F.array(length, length - 1)).alias("m")).where(F.col("m") >= LETTERS)
    parts = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    parts = parts.withColumns({"low": _bound(F.col("part")), "high": _bound(F.col("part") + 1)})
    thirds = parts.withColumns({"begin": F.col("low"), "end": F.col("high")}).withColumn("key", _key()).select(_ROW)
    large = thirds.groupBy("key").count().where(F.col("count") > MEMBERS).select("key")
    step = F.ceil((F.col("high") - F.col("low")) / STEPS).cast("int")
    split = thirds.join(large, "key", "left_semi").withColumn("begin", F.explode(F.sequence(F.col("low"), F.col("high") - 1, step)))
    split = split.withColumn("end", F.least("high", F.col("begin") + step)).withColumn("key", _key()).select(_ROW)
    return thirds.join(large, "key", "left_anti").select(_ROW).unionByName(split)


def _bound(part: Column) -> Column:
    return F.floor(F.col("m") * part / PARTS).cast("int")


def _key() -> Column:
    """Hash of the letters before ``begin`` and of those after ``end`` of the shorter word's m letters, the latter told from the end."""
    after = F.col("m") - F.col("end")
    return F.xxhash64("m", "begin", "end", F.substring(F.col("word"), F.lit(1), F.col("begin")), F.substring(F.col("word"), F.length("word") - after + 1, after))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of all places in [low, high) of every row."""
    n = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]


def _merged(a: np.ndarray, b: np.ndarray, rows: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of merged postings that come up at least ``least[a]`` times."""
    pair, n = np.unique(a * rows + b, return_counts=True)
    first, second = pair // rows, pair % rows
    keep = n >= least[first]
    return first[keep], second[keep]


def candidates(group: np.ndarray, extra: np.ndarray, begin: np.ndarray, end: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group with enough positional letter pairs in common: the first row's word is the shorter or as long.

    ``begin`` and ``end`` bound the part left out in the shorter word; ``extra`` is 1 for words with one letter more;
    ``chars`` holds a sentinel, the letters and zeros. v + 1 letter pairs touch a part of v letters. A replaced letter
    leaves v - 1 of them in place; an inserted one leaves v of the shorter word's, in place or one place later.
    """
    rows = len(group)
    pairs = end - begin + 1 + extra
    row, at = _spread(begin, begin + pairs)
    gram = chars[row, at].astype(np.int64) << 8 | chars[row, at + 1]
    width = chars.shape[1] + 1

    def posting(kind: np.ndarray, place: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (kind * width + place) << 16 | of

    code = posting(group[row] * 2 + extra[row], at, gram)
    order = np.argsort(code, kind="stable")
    code, row, at, gram = code[order], row[order], at[order], gram[order]
    probe = np.flatnonzero(extra[row] == 0)
    # as long: later members of the same posting list
    left, place = _spread(probe + 1, np.searchsorted(code, code[probe], side="right"))
    first, second = _merged(row[probe[left]], row[place], rows, end - begin - 1)
    found = [(first, second)]
    single = np.flatnonzero((extra == 0) & (end - begin == 1))  # one letter left out and no more: all members differ in it alone
    if len(single):
        of = group[single]
        left, place = _spread(np.arange(1, len(single) + 1), np.searchsorted(of, of, side="right"))
        found = [(first[keep := end[first] - begin[first] > 1], second[keep]), (single[left], single[place])]
    # one letter more: the same place or the next
    hits = []
    for later in (0, 1):
        wanted = posting(group[row[probe]] * 2 + 1, at[probe] + later, gram[probe])
        left, place = _spread(np.searchsorted(code, wanted), np.searchsorted(code, wanted, side="right"))
        hits.append((row[probe[left]], row[place]))
    found.append(_merged(np.concatenate([a for a, _ in hits]), np.concatenate([b for _, b in hits]), rows, end - begin))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _letters(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def near_pairs(rows: pd.DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of places in ``rows`` (sorted by key; words of m or m + 1 letters), each in one group only: the first that both are in."""
    words = [w.encode("latin-1") for w in rows.word]
    group, extra = pd.factorize(rows.key)[0].astype(np.int64), rows.word.str.len().to_numpy(np.int64) - m
    part, low, high, begin, end = (rows[c].to_numpy(np.int64) for c in ("part", "low", "high", "begin", "end"))
    chars, tails = _letters([b"\1" + w for w in words], m + 3), _letters([w[::-1] for w in words], m + 1)
    weight = np.cumsum(np.bincount(group) ** 2)
    chunk = (weight // MERGED)[group]
    a, b = [], []
    for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(chunk)) + 1):
        first, second = candidates(group[at] - group[at[0]], extra[at], begin[at], end[at], chars[at])
        first, second = at[first], at[second]
        before = (chars[first, 1 : m + 1] == chars[second, 1 : m + 1]).cumprod(1).sum(1)
        after = (tails[first, :m] == tails[second, :m]).cumprod(1).sum(1)
        near = np.where(extra[second] == 1, before + after >= m, (before < m) & (before + after >= m - 1))
        mine = ((low[first] < m - after) | (part[first] == 0)) & (m - after <= high[first]) & (before >= low[first])
        place = np.maximum(low[first], m - 1 - after)
        mine &= (begin[first] <= place) & (place < end[first])
        a.append(first[near & mine])
        b.append(second[near & mine])
    return np.concatenate(a), np.concatenate(b)


def _nearest_of(rows: pd.DataFrame) -> pd.DataFrame:
    """Per word of a bucket: how many near words it found here, and the most frequent of them."""
    rows = rows.sort_values(["m", "key"], kind="stable", ignore_index=True)
    code, words = pd.factorize(rows.word.to_numpy(object), sort=True)
    n, pairs = np.zeros(len(words), np.int64), [(np.zeros(0, np.int64),) * 2]
    n[code] = rows.n
    for m, part in rows.groupby("m"):
        a, b = near_pairs(part.reset_index(drop=True), int(m))
        pairs.append((code[part.index[a]], code[part.index[b]]))
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.diff(a, prepend=-1))
    return pd.DataFrame({"word": words[a[first]], "n_near": np.diff(np.append(first, len(a))), "form": words[b[first]], "form_n": n[b[first]]})


def nearest_words(words: DataFrame) -> DataFrame:
    """word, n_near and the near word of largest n (ties: the smallest), for the words that have one."""
    buckets = max(1, math.ceil(2 * PARTS * words.count() / BUCKET))
    found = _grouped(words).groupBy(F.pmod("key", F.lit(buckets))).applyInPandas(_nearest_of, "word string, n_near long, form string, form_n long")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    return best.select("word", "n_near", F.col("best.form").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word with its form (the near word of largest n, if TIMES as frequent, else null) and root: word, form, root, n, n_near, form_n.

    Forms double in frequency, so a chain has at most log2 of the largest n links and the logarithm of that many joins
    finds all roots. Null texts have no words, a null id counts as '', rows that repeat an id or a text count each.
    """
    counted = materialise(words(docs, id_col, text_col))
    joined = counted.join(nearest_words(counted), "word", "left")
    leads = F.col("near_n") >= TIMES * F.col("n")
    rows = materialise(joined.select("word", F.when(leads, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("near_n")).alias("form_n")))
    most = rows.agg(F.coalesce(F.max("n"), F.lit(1))).head()[0]
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(1 + math.log(most, TIMES)))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        roots = materialise(roots.join(onward, "root", "left").select("word", F.coalesce("onward", "root").alias("root")))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
