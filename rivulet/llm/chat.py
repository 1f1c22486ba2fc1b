"""Chat formatting with typed content parts (operator 1).

A visitor flattens the text, image, audio and document parts of a turn into text with placeholders in order, recording
each attachment's reference and its expanded token count. Turns are marked by control strings; control strings inside
texts and roles are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Tokens that stand for an attachment: a square image patch's side in pixels, audio frames a second, tokens a document page.
PATCH, FRAMES, PAGE = 28, 12.5, 600
#: Columns of a typed part; a text turn is one text part.
PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.LongType())])
SEGMENT = (
    "conv_id string, turn string, role string, segment string, loss_start long, loss_end long, "
    "attachments array<struct<placeholder: string, kind: string, ref: string, tokens: long>>, expanded_tokens long"
)

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_PLACEHOLDER = re.compile(r"<\|\w+_(\d+)\|>")
_SEGMENT = re.compile(r"\A<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n\Z", re.S)


def escape(text: str) -> str:
    """Puts one more backslash into every ``<|``, so that none is left."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _size(part: dict, name: str) -> float:
    """A part's measure; 0 if it is missing, negative or not finite (JSON holds such numbers as text)."""
    value = float(part.get(name) or 0)
    return value if 0 < value < math.inf else 0.0


class Flattener:
    """Visits the parts of one turn; unknown kinds are attachments without tokens."""

    def __init__(self):
        self.out, self.attachments, self.tokens = [], [], 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.out.append(escape(text))
        self.tokens += len(text.split())

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil(_size(part, "width") / PATCH) * math.ceil(_size(part, "height") / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil(_size(part, "seconds") * FRAMES))

    def visit_document(self, part: dict) -> None:
        self._attach(part, int(_size(part, "pages")) * PAGE)

    def visit_other(self, part: dict) -> None:
        self._attach(part, 0)

    def _attach(self, part: dict, tokens: int) -> None:
        kind = re.sub(r"\W", "_", part["type"])
        place = f"<|{kind}_{len(self.attachments)}|>"
        self.attachments.append({"placeholder": place, "kind": part["type"], "ref": part.get("ref"), "tokens": int(tokens)})
        self.out.append(place)
        self.tokens += int(tokens)


def format_turn(role: str | None, content) -> dict:
    """One turn's segment, the span of its text in code points where loss is taken (assistant turns), and its attachments."""
    flat = Flattener()
    for part in [{"type": "text", "text": content}] if content is None or isinstance(content, str) else content:
        if part is not None:
            flat.visit(part if isinstance(part, dict) else part.asDict())
    body = "".join(flat.out)
    head = f"{OPEN}{_role_out(role or '')}\n"
    masked = role == "assistant"
    return {
        "segment": f"{head}{body}{CLOSE}\n", "loss_start": len(head) if masked else 0, "loss_end": len(head) + len(body) if masked else 0,
        "attachments": flat.attachments, "expanded_tokens": flat.tokens,
    }


def parse_segment(segment: str) -> tuple[str, str]:
    """The role and the text (placeholders stay) of a segment."""
    role, body = _SEGMENT.match(segment).groups()
    return _role_in(role), unescape(body)


def parse_parts(segment: str) -> tuple[str, list[tuple[str, int | None]]]:
    """The role and, in order, the parts of a segment: (text, None) and (placeholder, its number).

    Told before texts are unescaped, so a text that looks like a placeholder is a text. Neighbouring texts are one part.
    """
    role, body = _SEGMENT.match(segment).groups()
    parts, at = [], 0
    for found in _PLACEHOLDER.finditer(body):
        parts += [(unescape(body[at : found.start()]), None)] * (found.start() > at) + [(found[0], int(found[1]))]
        at = found.end()
    return _role_in(role), parts + [(unescape(body[at:]), None)] * (at < len(body))


PARTS = "conv_id string, turn string, role string, parts array<struct<kind: string, text: string, ref: string, tokens: long>>"


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) read from the formatted segments: texts as written, and attachments with their reference and tokens in their places. Neighbouring texts come back as one, empty ones not at all."""
    ids = segments.select("conv_id", "turn").schema
    rows = segments.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "segment", F.to_json("attachments").alias("attachments"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                role, parts = parse_parts(row.segment)
                held = json.loads(row.attachments)
                told = [{"kind": "text", "text": text, "ref": None, "tokens": None} if n is None else {"kind": held[n]["kind"], "text": None, "ref": held[n].get("ref"), "tokens": held[n]["tokens"]} for text, n in parts]
                made.append((row.conv_id, row.turn, role, told))
            yield pd.DataFrame(made, columns=["conv_id", "turn", "role", "parts"])

    made = rows.mapInPandas(run, PARTS)
    return made.select(F.col("conv_id").cast(ids["conv_id"].dataType), F.col("turn").cast(ids["turn"].dataType), "role", "parts")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text") -> DataFrame:
    """One formatted segment per turn row; a conversation's text is its segments in order of turn.

    ``content_col`` holds a string or an array of PART structs. A null text or part is empty, a null role is the empty
    role; measures that are missing, negative or not finite count as 0; other columns are not read. Rows are formatted
    where they lie: nothing is shuffled.
    """
    ids = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn")).schema
    # ids travel as text: pandas would make floats of whole numbers beside a null
    rows = turns.select(F.col(conv_col).cast("string").alias("conv_id"), F.col(turn_col).cast("string").alias("turn"), F.col(role_col).alias("role"), (F.to_json(content_col) if isinstance(turns.schema[content_col].dataType, T.ArrayType) else F.col(content_col)).alias("content"))
    typed = isinstance(turns.schema[content_col].dataType, T.ArrayType)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            contents = [json.loads(c) if typed and c is not None else c for c in rows.content]
            made = pd.DataFrame([format_turn(r, c) for r, c in zip(rows.role, contents, strict=True)], columns=["segment", "loss_start", "loss_end", "attachments", "expanded_tokens"])
            yield pd.concat([rows[["conv_id", "turn", "role"]].reset_index(drop=True), made], axis=1)

    made = rows.mapInPandas(run, SEGMENT)
    return made.select(F.col("conv_id").cast(ids["conv_id"].dataType), F.col("turn").cast(ids["turn"].dataType), *made.columns[2:])


DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, expanded_tokens long, n_attachments long"


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted segments: digests of its turns and of the text under the loss mask.

    Segments are dealt by conversation and sorted by (turn, role, segment); one pass hashes them as they stream by, so
    memory holds one batch, however long a conversation is. Null conv_ids form one conversation.
    """
    ordered = segments.select("conv_id", "turn", "role", "segment", "loss_start", "loss_end", F.size("attachments").alias("attached"), "expanded_tokens")
    ordered = ordered.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "segment")
    kind = segments.schema["conv_id"].dataType
    ordered = ordered.drop("turn").withColumn("conv_id", F.col("conv_id").cast("string"))  # as text: pandas would make floats of whole numbers beside a null

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None

        def ended(s) -> list:
            return [s["conv_id"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["tokens"], s["attached"]]

        for rows in batches:
            done = []
            for row in rows.itertuples(index=False):
                conv_id = None if pd.isna(row.conv_id) else row.conv_id
                if state is None or state["conv_id"] != conv_id:
                    if state is not None:
                        done.append(ended(state))
                    state = {"conv_id": conv_id, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "tokens": 0, "attached": 0}
                role, text = parse_segment(row.segment)
                masked = unescape(row.segment[row.loss_start : row.loss_end])
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode())
                state["loss_chars"] += len(masked)
                state["loss"].update(masked.encode())
                state["chars"] += len(row.segment)
                state["tokens"] += row.expanded_tokens
                state["attached"] += row.attached
            yield _digest_frame(done)
        if state is not None:
            yield _digest_frame([ended(state)])

    return ordered.mapInPandas(run, DIGEST).withColumn("conv_id", F.col("conv_id").cast(kind))


def _digest_frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in DIGEST.split(", ")])
