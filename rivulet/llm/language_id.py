"""Language identification by a linear-chain conditional random field (operator 4).

Words of a text form a chain; each is scored for every language by hashed affixes, inner n-grams and lexicon entries,
neighbours by learned transitions. Forward-backward gives each word's language probabilities, so texts may switch
languages. A document's language is the one with the largest mean probability.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import held_out, keep_rows, text_or_empty

#: A fit reads at most so many documents a language (in hash order of the id, longer ones last), and so many characters of each.
FIT_DOCS, FIT_CHARS = 120, 20_000
ITERATIONS, RATE, RIDGE = 20, 0.4, 1e-3
#: Size of the hashed feature space; letters of a word (a longer run of letters is several words); longest n-gram.
SPACE, LETTERS, ORDER = 1 << 17, 20, 4
#: Words that one pass of forward-backward holds (a square number); a longer text passes its messages on from part to part. Words that a worker remembers.
CHAIN, KNOWN = 387**2, 200_000
UNKNOWN = "und"
#: Share of the way from chance (1 / languages) to certainty below which a mean probability tells no language: 0.3 among four.
LEAST = 1 / 15


def words_of(token: str) -> list[str]:
    """The runs of lower-case letters in a token, long ones in consecutive pieces; tokens without letters have none.

    Each has the character before and after it at its ends: a letter where a run is cut, else a space. Marks and format
    characters part no run, they are left out.
    """
    if not token.isalpha():
        token = "".join(c if c.isalpha() else "" if unicodedata.category(c) in ("Mn", "Mc", "Me", "Cf") else " " for c in token)
    return [f" {run} "[i : i + LETTERS + 2] for run in token.lower().split() for i in range(0, len(run), LETTERS)]


def feature_ids(words: list[str]) -> np.ndarray:
    """Hashed features of words with their neighbours, -1 where there is none: [word, feature]. Affixes are n-grams at the edges; the lexicon entry is the whole word."""
    inner = [w[1:-1] for w in words]
    codes = np.array(inner, dtype=f"U{LETTERS}").view(np.uint32).reshape(len(words), LETTERS).astype(np.uint64)
    n = (codes > 0).sum(1)
    edged = np.zeros((len(words), LETTERS + 2), np.uint64)
    edged[:, 0] = [2 if w[0] == " " else ord(w[0]) for w in words]
    edged[:, 1:-1] = codes
    edged[np.arange(len(words)), n + 1] = [3 if w[-1] == " " else ord(w[-1]) for w in words]
    made, gram = [], edged.copy()
    for size in range(1, ORDER + 1):
        width = edged.shape[1] - size + 1
        if size > 1:
            gram = gram[:, :width] * np.uint64(0x9E3779B97F4A7C15) + edged[:, size - 1 :]
        mixed = gram[:, :width] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        ids = (mixed >> np.uint64(40)).astype(np.int64) % (SPACE // 2)
        made.append(np.where(np.arange(width) + size <= (n + 2)[:, None], ids, -1))
    whole = np.zeros(len(words), np.uint64)
    for i in range(LETTERS):
        whole = np.where(codes[:, i] > 0, (whole ^ codes[:, i]) * np.uint64(0x100000001B3), whole)
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    made.append((SPACE // 2 + (whole >> np.uint64(40)).astype(np.int64) % (SPACE // 2))[:, None])
    return np.concatenate(made, 1)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # [feature, language]; the last row is zero
    transitions: np.ndarray  # [from, to]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores [word, language] of feature ids; -1 finds the zero row."""
        out = np.zeros((len(ids), len(self.languages)))
        for column in ids.T:
            out += self.weights[column]
        return out


def forward_backward(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised forward and backward messages and potentials of chains that stand one after another; ``starts`` marks first words.

    The row of words is cut into equal blocks. Products of the blocks' transfer matrices carry the messages from block
    to block, so all blocks advance together and no chain is cut; a start forgets what was before. ``before`` is the
    message of the last word ahead of the first one, ``behind`` (for a square number of words) the one that the last gets.
    """
    n, k = scores.shape
    size = max(1, int(np.sqrt(n)))
    rows = -(-n // size)
    potential = np.exp(scores - scores.max(1, keepdims=True))
    padded = np.ones((rows * size, k))
    padded[:n] = potential
    fresh = np.ones(rows * size, bool)
    fresh[:n] = starts
    psi, fresh = padded.reshape(rows, size, k), fresh.reshape(rows, size)
    a = np.exp(transitions - transitions.max())

    def step(messages, c):
        moved = np.where(fresh[:, c].reshape(-1, *[1] * (messages.ndim - 1)), messages.sum(-1, keepdims=True), messages @ a)
        moved = moved * (psi[:, c, None, :] if messages.ndim == 3 else psi[:, c])
        return moved / moved.sum(tuple(range(1, messages.ndim)), keepdims=True)

    block = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for c in range(size):
        block = step(block, c)
    first, last = np.full((rows, k), 1 / k), np.full((rows, k), 1 / k)
    if before is not None:
        first[0] = before
    if behind is not None:
        last[-1] = behind
    for r in range(1, rows):
        moved = first[r - 1] @ block[r - 1]
        first[r] = moved / moved.sum()
    for r in range(rows - 2, -1, -1):
        moved = block[r + 1] @ last[r + 1]
        last[r] = moved / moved.sum()
    alpha, beta = np.empty((rows, size, k)), np.empty((rows, size, k))
    at = first
    for c in range(size):
        at = alpha[:, c] = step(at, c)
    at = last
    for c in range(size - 1, -1, -1):
        beta[:, c] = at
        inner = psi[:, c] * at
        moved = np.where(fresh[:, c, None], inner.sum(1, keepdims=True), inner @ a.T)
        at = moved / moved.sum(1, keepdims=True)
    return alpha.reshape(-1, k)[:n], beta.reshape(-1, k)[:n], padded[:n]


def marginals(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    alpha, beta, _ = forward_backward(scores, starts, transitions)
    both = alpha * beta
    return both / both.sum(1, keepdims=True)


def fit(texts: list[str], languages: list[str]) -> Crf | None:
    """Maximises the regularised likelihood by full-batch adaptive gradient steps; every word of a text carries its language."""
    names = sorted(set(languages))
    chains = [[w for token in t.split() for w in words_of(token)] for t in texts]
    used = [(c, names.index(lang)) for c, lang in zip(chains, languages, strict=True) if c]
    if not used:
        return None
    index: dict[str, int] = {}
    at = np.array([index.setdefault(w, len(index)) for c, _ in used for w in c])
    truth = np.array([y for c, y in used for _ in c])
    starts = np.zeros(len(at), bool)
    starts[np.cumsum([0, *[len(c) for c, _ in used[:-1]]])] = True
    ids = feature_ids(list(index))
    k = len(names)
    crf = Crf(names, np.zeros((SPACE + 1, k)), np.zeros((k, k)))
    gw, gt = np.full_like(crf.weights, 1e-8), np.full_like(crf.transitions, 1e-8)
    flat = np.where(ids < 0, SPACE, ids).ravel()
    weight = 1 / np.bincount(truth, minlength=k)[truth]  # languages count alike, however much text they have
    inner = ~starts[1:]
    for _ in range(ITERATIONS):
        scores = crf.emissions(ids)[at]
        alpha, beta, psi = forward_backward(scores, starts, crf.transitions)
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        error = -p
        error[np.arange(len(at)), truth] += 1
        error *= weight[:, None]
        per_word = np.stack([np.bincount(at, error[:, j], len(index)) for j in range(k)], 1)
        grad = np.stack([np.bincount(flat, np.repeat(per_word[:, j], ids.shape[1]), SPACE + 1) for j in range(k)], 1)
        grad = grad - RIDGE / len(index) * crf.weights
        grad[SPACE] = 0
        pairs = alpha[:-1, :, None] * np.exp(crf.transitions) * (psi * beta)[1:, None, :]
        pairs = pairs / pairs.sum((1, 2), keepdims=True) * weight[1:, None, None]
        seen = np.zeros((k, k))
        np.add.at(seen, (truth[:-1][inner], truth[1:][inner]), weight[1:][inner])
        moved = seen - pairs[inner].sum(0) - 10 * RIDGE * crf.transitions
        gw += grad**2
        gt += moved**2
        crf.weights += RATE * grad / np.sqrt(gw)
        crf.transitions += RATE * moved / np.sqrt(gt)
    crf.weights = crf.weights.astype(np.float32)
    return crf


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = FIT_DOCS) -> Crf | None:
    """Fits on a bounded sample: the first ``per_language`` documents of each language by a hash of id, text and language, outside the held-out fifth.

    Documents of more than ``FIT_CHARS`` characters come after all others, with their first ``FIT_CHARS``.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id", 5, 0))
    keys = rows.select("lang", F.xxhash64("id", "text", "lang").alias("key"), (F.length("text") > FIT_CHARS).alias("long"))
    order = Window.partitionBy("lang").orderBy("long", "key")
    chosen = keys.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("key").distinct()
    sample = rows.withColumn("key", F.xxhash64("id", "text", "lang")).join(F.broadcast(chosen), "key", "left_semi").withColumn("text", F.substring("text", 1, FIT_CHARS)).dropDuplicates(["key"]).orderBy("key").toPandas()
    return fit(sample.text.tolist(), sample.lang.tolist())


class Labeller:
    """Scores words for one worker, remembering the emissions of words that it has seen."""

    def __init__(self, crf: Crf):
        self.crf, self.index, self.words, self.known = crf, {}, {}, np.zeros((0, len(crf.languages)), np.float32)

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``known`` for all words of the texts, and the number of words of each text."""
        if len(self.index) > KNOWN or len(self.words) > KNOWN:
            self.index, self.words, self.known = {}, {}, self.known[:0]
        index, words, long, out, counts = self.index, self.words, [], [], []
        for text in texts:
            tokens = text.split()
            for token in tokens:
                if token not in index:
                    index[token] = tuple(words.setdefault(w, len(words)) for w in words_of(token))
                    if len(token) > 2 * LETTERS:
                        long.append(token)
            out.append(np.fromiter((row for t in tokens for row in index[t]), np.int64))
            counts.append(len(out[-1]))
        for token in long:  # their words are remembered
            del index[token]
        fresh = list(islice(words, len(self.known), None))
        if fresh:
            parts = [self.crf.emissions(feature_ids(fresh[i : i + 20_000])).astype(np.float32) for i in range(0, len(fresh), 20_000)]
            self.known = np.concatenate([self.known, *parts])
        return np.concatenate(out) if out else np.zeros(0, np.int64), np.array(counts, np.int64)

    def probabilities(self, rows: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first word, language probabilities) of consecutive words; whole texts share a pass, so none depends on what else is in it."""
        firsts = np.cumsum(counts) - counts
        starts = np.zeros(len(rows), bool)
        starts[firsts[counts > 0]] = True
        text = 0
        while text < len(counts):
            end = max(text + 1, int(np.searchsorted(firsts + counts, firsts[text] + CHAIN, "right")))
            at, to = int(firsts[text]), int(firsts[end - 1] + counts[end - 1])
            if to - at <= CHAIN:
                if to > at:
                    yield at, marginals(self.known[rows[at:to]].astype(float), starts[at:to], self.crf.transitions)
            else:
                yield from self._long(rows, starts, at, to)
            text = end

    def _long(self, rows: np.ndarray, starts: np.ndarray, at: int, to: int) -> Iterator[tuple[int, np.ndarray]]:
        """One long text: a forward sweep over its parts keeps one message each, the backward sweep gives the probabilities."""
        parts = [slice(i, min(i + CHAIN, to)) for i in range(at, to, CHAIN)]
        a, message, messages = self.crf.transitions, None, []
        for part in parts:
            messages.append(message)
            message = forward_backward(self.known[rows[part]].astype(float), starts[part], a, message)[0][-1]
        behind = None
        for part, message in zip(reversed(parts), reversed(messages), strict=True):
            alpha, beta, potential = forward_backward(self.known[rows[part]].astype(float), starts[part], a, message, behind)
            both = alpha * beta
            yield part.start, both / both.sum(1, keepdims=True)
            behind = np.exp(a - a.max()) @ (potential[0] * beta[0])
            behind = behind / behind.sum()

    def documents(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and mean probability of each text, in groups of texts that fit one pass."""
        languages, scores = [], []
        for group in _groups(texts):
            rows, counts = self.rows(group)
            sums = np.zeros((len(group), len(self.crf.languages)))
            owner = np.repeat(np.arange(len(group)), counts)
            for i, p in self.probabilities(rows, counts):
                for j in range(p.shape[1]):
                    sums[:, j] += np.bincount(owner[i : i + len(p)], p[:, j], len(group))
            best = sums.argmax(1)
            for i, n in enumerate(counts):
                languages.append(self.crf.languages[best[i]] if n else UNKNOWN)
                scores.append(float(min(1.0, sums[i, best[i]] / n)) if n else 0.0)
        return languages, scores

    def spans(self, text: str) -> list[dict]:
        """Runs of words of one language: {first, last, lang}, words counted from 0 as ``words_of`` parts them."""
        rows, counts = self.rows([text])
        if not len(rows):
            return []
        best = np.zeros(len(rows), np.int64)
        for i, p in self.probabilities(rows, counts):
            best[i : i + len(p)] = p.argmax(1)
        cuts = [0, *(np.flatnonzero(np.diff(best)) + 1).tolist(), len(best)]
        return [{"first": a, "last": b - 1, "lang": self.crf.languages[best[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > 4 * CHAIN:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def detect(docs: DataFrame, crf: Crf | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred and score (mean probability of that language over the words).

    A text that is null or has no letter is ``und`` with score 0; so is every text if there is nothing to learn from.
    Ids, languages and sources are no inputs of a prediction. Rows stay as they are, nothing is shuffled.
    """
    crf = crf or train(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), text_or_empty(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labeller = Labeller(shared.value) if shared.value else None
        for rows in batches:
            texts = rows.text.tolist()
            languages, scores = labeller.documents(texts) if labeller else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"doc_id": rows.doc_id, "lang_pred": languages, "score": scores})

    found = rows.mapInPandas(run, "doc_id string, lang_pred string, score double")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a language that can be told (all, if there is nothing to learn from)."""
    crf = train(docs, id_col, text_col, lang_col)
    if crf is None:
        return docs
    shared, chance = docs.sparkSession.sparkContext.broadcast(crf), 1 / len(crf.languages)
    least = chance + LEAST * (1 - chance) if len(crf.languages) > 1 else 0.0

    def make():
        labeller = Labeller(shared.value)

        def test(texts: list[str]) -> np.ndarray:
            languages, scores = labeller.documents(texts)
            return (np.array(languages) != UNKNOWN) & (np.array(scores) >= least)

        return test

    return keep_rows(docs, text_col, make)
