"""Best-fit packing of token pieces into sequences (operator 12).

Pieces are tokenised where the documents lie; only their lengths travel. Lengths make a histogram of at most ``size``
rows, for which a configuration program is solved by multiplicative weights: prices of lengths say which configurations
(multisets of lengths that fit one sequence) are worth most, a knapsack by dynamic programming finds them, and what
they cover more than its share gets cheaper. Configurations are rounded to whole numbers within what is left, the rest is
solved again, and the last few pieces go best-fit decreasing. The plan has a size that depends on ``size`` alone; every
task deals its pieces to sequences from their number among the pieces of their length.
"""

from __future__ import annotations

import array
import json
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialise, text_or_empty

#: Tokens of a sequence, and the token that ends each document.
SIZE, END_ID = 1024, 2
#: Rounds of solving and rounding, steps of the weights in a round, their size, and how far below the best a configuration's worth may lie.
ROUNDS, STEPS, RATE, SLACK = 10, 10, 0.3, 0.005
#: Pieces of one length that a task numbers, on average.
NUMBERED = 500_000

def ranks_of(tokenizer: str) -> dict[bytes, int]:
    """The tokens of a byte-level vocabulary (a tokenizer's JSON text) as bytes, and their ids, which are their ranks.

    Printable Latin-1 characters stand for their own byte, the other bytes in order for the characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    byte_of = {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}
    model = json.loads(tokenizer)
    special = {t["content"] for t in model["added_tokens"]}
    return {bytes(byte_of[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in special}


#: One encoder per worker process and vocabulary.
_ENCODERS: dict[tuple, tiktoken.Encoding] = {}


def cut_document(ids: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of a document's pieces; all but the first have ``size`` tokens."""
    n = len(ids) // 4
    starts = [0, *range((n - 1) % size + 1, n, size)]
    return [(i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]


def pieces(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces. A null text counts as empty: its end is a piece of one token.

    ``tokenizer_path`` names a byte-level tokenizer's JSON file and ``pattern`` what its pre-tokenizer matches; strings of
    special tokens in a text are ordinary text. The ids are those of the tokenizers library, found by tiktoken from the
    same ranks at a third of the time.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(ranks_of(file.read()))  # a vocabulary has a fixed size
    of, key = F.col(id_col).cast("long"), (tokenizer_path, pattern)
    rows = docs.select(F.coalesce(of, F.lit(0)).alias("id"), of.isNull().alias("unknown"), text_or_empty(text_col).alias("text"))
    end = array.array("I", [end_id]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _ENCODERS:
            _ENCODERS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        encode = _ENCODERS[key].encode_ordinary
        for batch in batches:
            made = []
            for doc, null, text in zip(batch.id, batch.unknown, batch.text, strict=True):
                ids = array.array("I", encode(text)).tobytes() + end
                made += [(doc, null, *piece) for piece in cut_document(ids, size)]
            yield pd.DataFrame(made, columns=["id", "unknown", "piece", "start", "length", "ids_crc32"])

    made = rows.mapInPandas(run, "id long, unknown boolean, piece int, start long, length long, ids_crc32 long")
    return made.select(F.when(~F.col("unknown"), F.col("id")).alias("doc_id"), "piece", "start", "length", "ids_crc32")


# the configuration program, on a histogram
def price(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every room up to ``size`` the greatest worth of lengths that fit it, and the length to take first (0: leave one token)."""
    offered = np.flatnonzero(value > 0)[::-1]  # long ones first, so that ties take few pieces
    worth, first = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    begin = np.searchsorted(-offered, -np.arange(size + 1))
    for room in range(1, size + 1):
        fits = offered[begin[room] :]
        worth[room] = worth[room - 1]
        if len(fits):
            total = value[fits] + worth[room - fits]
            at = total.argmax()
            if total[at] > worth[room]:
                worth[room], first[room] = total[at], fits[at]
    return worth, first


def configurations(value: np.ndarray, left: np.ndarray, size: int) -> list[tuple[int, ...]]:
    """For every length that is left the best configuration with it, if its worth lies within SLACK of the best one."""
    worth, first = price(value, size)
    found = set()
    for length in np.flatnonzero(left):
        if value[length] + worth[size - length] >= (1 - SLACK) * worth[size]:
            made, room = [int(length)], size - int(length)
            while room:
                if take := int(first[room]):
                    made.append(take)
                room -= take or 1
            found.add(tuple(sorted(made, reverse=True)))
    return sorted(found)


def weigh(left: np.ndarray, size: int) -> dict[tuple[int, ...], float]:
    """Configurations and how often each is used, by multiplicative weights: prices fall with what is covered already. No length is covered more than once."""
    value, used, total = np.where(left > 0, np.arange(size + 1) / size, 0.0), Counter(), np.zeros(size + 1)
    for _ in range(STEPS):
        made = [(c, Counter(c)) for c in configurations(value, left, size)]
        times = [min(left[length] / n for length, n in of.items()) for _, of in made]
        covered = np.zeros(size + 1)
        for (_, of), t in zip(made, times, strict=True):
            for length, n in of.items():
                covered[length] += n * t
        share = np.divide(covered, left, out=np.zeros(size + 1), where=left > 0)
        for (c, _), t in zip(made, times, strict=True):
            used[c] += t / share.max()
        share /= share.max()
        total += share
        value *= np.exp(-RATE * (share - np.average(share, weights=left)))
    return {c: t / total.max() for c, t in used.items()}


def rounded(used: dict[tuple[int, ...], float], left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Configurations rounded down, within what is left (changed in place), the fullest first."""
    plan = []
    for made in sorted(used, key=lambda c: (-sum(c), -used[c], c)):
        of = Counter(made)
        times = min(math.floor(used[made]), *(int(left[length]) // n for length, n in of.items()))
        if times:
            plan.append((made, times))
            for length, n in of.items():
                left[length] -= n * times
    return plan


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing of what is left, all pieces of a length and all sequences of equal contents at once."""
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            room = min((r for r, held in by_room.items() if r >= length and held), default=size)
            held, many = by_room[room].popitem() if by_room.get(room) else ((), n)
            copies = min(room // length, n)  # the next of these goes where the last one went: no room is tighter
            times = min(many, n // copies)
            if held and many > times:
                by_room[room][held] = many - times
            at = by_room.setdefault(room - copies * length, {})
            made = held + (length,) * copies
            at[made] = at.get(made, 0) + times
            n -= copies * times
    return [(made, n) for held in by_room.values() for made, n in held.items()]


def solve(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Configurations and how many sequences take each; together they hold every piece of the histogram exactly once."""
    left, plan = np.zeros(size + 1, np.int64), []
    for length, n in histogram.items():
        left[length] = n
    for _ in range(ROUNDS):
        before = left.sum()
        if before:
            plan += rounded(weigh(left, size), left)
        if before == left.sum():
            break
    return plan + best_fit(left, size)


@dataclass
class Deal:
    """The plan by length: numbers at which each configuration begins, its first sequence, its copies of the length and the place of the first."""

    begins: dict[int, np.ndarray]
    rows: dict[int, np.ndarray]
    sequences: int

    def place(self, length: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of a length with these numbers."""
        at = np.searchsorted(self.begins[length], number, side="right") - 1
        first, copies, offset = self.rows[length][at].T
        rest = number - self.begins[length][at]
        return first + rest // copies, offset + rest % copies * length


def deal(plan: list[tuple[tuple[int, ...], int]]) -> Deal:
    begins, rows, next_of, sequence = {}, {}, Counter(), 0
    for made, times in plan:
        offset = 0
        for length, copies in sorted(Counter(made).items(), reverse=True):
            begins.setdefault(length, []).append(next_of[length])
            rows.setdefault(length, []).append((sequence, copies, offset))
            next_of[length] += copies * times
            offset += copies * length
        sequence += times
    return Deal({k: np.array(v, np.int64) for k, v in begins.items()}, {k: np.array(v, np.int64) for k, v in rows.items()}, sequence)


def _numbered(rows: DataFrame, n: int) -> DataFrame:
    """``number`` of each piece among those of its length, from 0 and gapless: counted by hash buckets, so no length is one task's."""
    buckets = max(1, math.ceil(n / NUMBERED))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return rows.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("number", F.col("before") + F.col("within"))


def pack(docs: DataFrame, tokenizer_path: str, pattern: str, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids end with ``end_id``; longer ones than ``size`` are cut, the first piece being the shorter one. A piece
    of ``size`` tokens is a sequence of its own. Null texts count as empty, null ids stay null, rows that repeat an id or
    both id and text are packed each; an empty table has no pieces.
    """
    spark = docs.sparkSession
    made = materialise(pieces(docs, tokenizer_path, pattern, size, end_id, id_col, text_col))
    histogram = {r.length: r.n for r in made.where(F.col("length") < size).groupBy("length").agg(F.count("*").alias("n")).collect()}  # fewer rows than size
    plan = deal(solve(histogram, size))
    shared = spark.sparkContext.broadcast(plan)
    full = made.where(F.col("length") == size).select("*", (F.monotonically_increasing_id() + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros((2, len(batch)), np.int64)
            lengths = batch.length.to_numpy()
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                sequence[at], offset[at] = shared.value.place(int(length), batch.number.to_numpy()[at])
            yield batch.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    columns = ["id", "unknown", "piece", "start", "length", "ids_crc32", "number"]
    rows = made.where(F.col("length") < size).withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("unknown", F.col("doc_id").isNull())
    placed = _numbered(rows, sum(histogram.values())).select(columns).mapInPandas(run, "id long, unknown boolean, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    placed = placed.withColumn("doc_id", F.when(~F.col("unknown"), F.col("id"))).select(full.columns)
    return placed.unionByName(full)
