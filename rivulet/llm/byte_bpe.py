"""Byte-level BPE by monoid tree reduction (operator 9).

A piece's encoding is the product of its halves' encodings. The product re-encodes a window around the seam that grows
until the tokens outside it cannot change. The proof used: a token sequence is the encoding of its bytes exactly if each
adjacent pair is the encoding of that pair's bytes. So tokens outside a window stay once both seams of the window hold
valid pairs. Decoding concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.common import text_or_empty

#: Bytes that a leaf of the encoding tree holds, and tokens that one of the decoding tree holds.
LEAF_BYTES, LEAF_TOKENS = 3, 1 << 16
#: Entries of a worker's caches of words, of parts of words and of pairs of tokens, and the longest strings that they keep.
WORDS, PARTS, PAIRS, CACHED_BYTES, CACHED_CHARS = 280_000, 100_000, 240_000, 32, 24
#: Rows whose texts and ids a task holds as Python objects at once.
ROWS = 256
#: Bytes up to which a search of all pairs beats a heap of them.
SHORT = 32


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` file (base64 token and rank per line); a vocabulary has a fixed size."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Recent(dict):
    """The values last used, at most ``most`` of them: when half as many are new or used again, those not used since the last time go. None for others."""

    def __init__(self, most: int):
        super().__init__()
        self.half, self.before = most // 2, {}

    def __missing__(self, key):
        found = self.before.get(key)
        if found is not None:
            self.keep(key, found)
        return found

    def keep(self, key, value) -> None:
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = value


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.length = np.array([len(x) for x in self.bytes_of] or [0])
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.seams, self.parts, self.words = Recent(PAIRS), Recent(PARTS), Recent(WORDS)  # by two tokens, by bytes, by word

    def merge(self, data: bytes) -> list[int]:
        """Direct merging of the lowest rank, leftmost first; a heap of pairs and links between parts keep long strings cheap."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        if n <= SHORT:
            return self._merge_short(data)
        parts = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i, data[i : i + 2]) for i in range(n - 1) if (rank := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i] if parts[i] else n
            if j >= n or len(parts[i]) + len(parts[j]) != len(joined):
                continue  # one of the two has grown or is gone
            parts[i], parts[j], k = joined, b"", after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (rank := ranks.get(joined + parts[k])) is not None:
                    heapq.heappush(heap, (rank, i, joined + parts[k]))
            h = before[i]
            if h >= 0 and (rank := ranks.get(parts[h] + joined)) is not None:
                heapq.heappush(heap, (rank, h, parts[h] + joined))
        return [ranks[p] for p in parts if p]

    def _merge_short(self, data: bytes) -> list[int]:
        rank, none = self.ranks.get, len(self.bytes_of)
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            joined = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(joined + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + joined, none)
        return [self.ranks[p] for p in parts]

    def seam(self, a: int, b: int) -> list[int] | tuple[()]:
        """The encoding of two tokens' bytes; empty if the pair is valid, that is, its own encoding."""
        key = a * len(self.bytes_of) + b
        found = self.seams[key]
        if found is None:
            found = self.merge(self.bytes_of[a] + self.bytes_of[b])
            if len(found) == 2 and found[0] == a:  # then the other is b
                found = ()
            self.seams.keep(key, found)
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of both byte strings together.

        A window around the seam is re-encoded. It grows to the left until the pair before it is valid, and to the right
        token by token until the pair behind it is; what lies outside then stays.
        """
        if not left or not right:
            return left + right
        out = left[:]
        for j, token in enumerate(right):
            window = self.seam(out[-1], token)
            if not window:
                return out + right[j:] if j else left + right
            out.pop()
            width = 1
            while out and self.seam(out[-1], window[0]):
                window = self.merge(b"".join([self.bytes_of[t] for t in out[-width:] + window]))
                del out[-width:]
                width *= 2
            out += window
        return out

    def encode_bytes(self, data: bytes) -> list[int]:
        """Encodes the halves and joins them; short strings are remembered. The depth is the logarithm of the length."""
        found = self.parts[data]
        if found is None:
            found = self._halves(data)
            if len(data) <= CACHED_BYTES:
                self.parts.keep(data, found)
        return found

    def _halves(self, data: bytes) -> list[int]:
        if data in self.ranks:
            return [self.ranks[data]]
        if len(data) <= LEAF_BYTES:
            return self.merge(data) if data else []
        half = len(data) // 2
        return self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))

    def pieces(self, text: str) -> bytes:
        """The ids of a text by the splitting pattern."""
        return array("I", [t for piece in self.find(text) for t in self.encode_bytes(piece.encode("utf-8", "surrogatepass"))]).tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a string without white space that follows a space; letters alone are one piece of any byte-level pattern."""
        if word.isalpha():
            return array("I", self._halves(f" {word}".encode())).tobytes()
        if word[-1] in ".," and word[:-1].isalpha():
            return array("I", self._halves(f" {word[:-1]}".encode()) + self.encode_bytes(word[-1].encode())).tobytes()
        return self.pieces(f" {word}")

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers.

        A single space between two other characters begins a piece in the byte-level patterns, so the strings between
        single spaces are encoded by themselves and remembered. Texts with other white space beside a space are split whole.
        """
        words = text.split(" ")
        known, out = self.words, []
        for i, word in enumerate(words):
            ids = known[word] if i else None
            if ids is None:
                if not word or word[0].isspace() or word[-1].isspace():
                    return self.pieces(text)
                ids = self.word(word) if i else self.pieces(word)
                if i and len(word) <= CACHED_CHARS:
                    known.keep(word, ids)
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Leaves gather the bytes of their tokens; the tree concatenates them."""
        tokens = np.frombuffer(ids, "<u4")
        level = [self._gather(tokens[i : i + LEAF_TOKENS]) for i in range(0, len(tokens), LEAF_TOKENS)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
        return level[0]

    def _gather(self, tokens: np.ndarray) -> bytes:
        length = self.length[tokens]
        end = np.cumsum(length)
        return self.flat[np.repeat(self.start[tokens] - end + length, length) + np.arange(end[-1])].tobytes()


#: One encoder per worker process and vocabulary, so that tasks share its caches.
_ENCODERS: dict[int, Bpe] = {}


def _encoder(key, ranks, pattern: str) -> Bpe:
    if key not in _ENCODERS:
        _ENCODERS[key] = Bpe(ranks.value, pattern)
    return _ENCODERS[key]


def _mapped(docs: DataFrame, path: str, pattern: str, make: Callable[[Bpe, list[str]], list[pa.Array]], schema: str) -> DataFrame:
    """Applies ``make`` to the texts of ``docs`` (doc_id, text), ``ROWS`` at a time: Spark's own batches hold up to 64 MB of texts, and their ids as much again."""
    spark = docs.sparkSession
    ranks, key = spark.sparkContext.broadcast(load_ranks(spark, path)), (path, pattern)
    names = ["doc_id", *[x.strip().split()[0] for x in schema.split(",")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(key, ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([rows.column(0), *make(bpe, rows.column(1).to_pylist())], names)

    return docs.mapInArrow(run, f"doc_id long, {schema}")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and token ids (array<int>) of every whole text, without special tokens. A null or empty text has no ids; rows keep their count, nothing is shuffled."""

    def make(bpe: Bpe, texts: list[str]) -> list[pa.Array]:
        ids = [bpe.encode(text) for text in texts]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))]

    return _mapped(_texts(docs, id_col, text_col), path, pattern, make, "ids array<int>")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, sha256 of its ids and of the bytes that decoding them gives. A null text counts as empty."""

    def make(bpe: Bpe, texts: list[str]) -> list[pa.Array]:
        ids = [bpe.encode(text) for text in texts]
        told = [[hashlib.sha256(x).hexdigest() for x in found] for found in (ids, map(bpe.decode, ids))]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), *[pa.array(x, pa.string()) for x in told]]

    return _mapped(_texts(docs, id_col, text_col), path, pattern, make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
