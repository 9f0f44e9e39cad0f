"""Chat formatting with a grammar that can be read back.

A turn is rendered as ``### Role: text``, an end of line, ``</turn>`` and an end of line. ``system``, ``user`` and ``assistant`` have names
of their own, any other role stands as a JSON string. A control string (``###`` or ``</turn>``) with a backslash before it is text, with one
backslash less; so any text can be written: one more backslash goes before each control string in it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
_ROLES = {name: role for role, name in NAMES.items()}
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"\\(\\*(?:###|</turn>))")
_NAME = re.compile("|".join(_ROLES))
_END = "\n</turn>\n"


def escaped(text: str) -> str:
    """A text in which no control string stands bare, and none with a backslash means less than it says."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    """What ``escaped`` was given."""
    return _ESCAPED.sub(r"\1", text)


def parse_turns(text: str) -> list[tuple[str, str, int, int]]:
    """``(role, text, start, end)`` of each turn of a formatted text; ``start`` and ``end`` are where the turn's text stands in it, as
    it is written there. The grammar is deterministic: from each place there is one way on, or a ``ValueError``."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith("### ", at):
            raise ValueError(f"no turn begins at {at}")
        name = _NAME.match(text, at + 4)
        if name:
            role, at = _ROLES[name.group()], name.end()
        else:
            role, at = json.JSONDecoder().raw_decode(text, at + 4)
        if not isinstance(role, str) or not text.startswith(": ", at):
            raise ValueError(f"no role before {at}")
        start = at + 2
        for found in _CONTROL.finditer(text, start):
            if not found.group(1):
                break
        else:
            raise ValueError(f"the turn at {start} has no end")
        end = found.start() - 1
        if end < start or not text.startswith(_END, end):
            raise ValueError(f"a control string stands at {found.start()}")
        out.append((role, unescaped(text[start:end]), start, end))
        at = end + len(_END)
    return out


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it is written, and where its text stands in it. The text is put in as it is, and the result parsed;
    where other turns come out than went in, what conflicts is escaped, and the result parsed again."""
    head = f"### {NAMES[role] if role in NAMES else json.dumps(role).replace('#', chr(92) + 'u0023').replace('<', chr(92) + 'u003c')}: "
    for shown in (text, escaped(text)):
        piece = head + shown + _END
        try:
            if parse_turns(piece) == [(role, text, len(head), len(head) + len(shown))]:
                return piece, len(head), len(head) + len(shown)
        except ValueError:  # the text conflicts with the grammar
            continue
    raise ValueError("a turn does not survive its round trip")


SPANS = "array<struct<start:bigint,end:bigint>>"


def format_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = ("assistant",), part_chars: int = 1_000_000
) -> DataFrame:
    """``(conv_id, task, part, whole, n_turns, formatted, loss)``: conversations as formatted texts; ``loss`` are the spans, in
    code points of ``formatted``, of the texts of ``learned`` roles.

    Turns are dealt to ranges of conversation and turn and put in order there, so a conversation of very many turns is many tasks'
    work; a task writes a conversation as one text, or as several beyond ``part_chars``. The parts of a conversation follow each other by
    ``(task, part)``; ``whole`` marks those that surely are all of it. Each turn is parsed as soon as it is rendered (``render_turn``).

    A null text or role is empty. Rows with a null conversation are one conversation, null. A null turn comes first; equal turns go by role and text;
    repeated rows are turns each. An empty table gives no rows. Other columns of ``turns`` are not read."""
    kind = turns.schema[conv].dataType
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["conv", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part, conv_type = TaskContext.get().partitionId(), 0, None
        last: object = None
        pieces: list[str] = []
        loss: list[dict] = []
        size, cut, rows_ = 0, True, []  # ``cut``: the part may go on from an earlier one

        def closed(goes_on: bool) -> None:
            nonlocal part, size, cut
            rows_.append((last, task, part, not (cut or goes_on), len(pieces), "".join(pieces), list(loss)))
            part, size, cut = part + 1, 0, goes_on
            pieces.clear()
            loss.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows_, strict=True))
            rows_.clear()
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            types = [conv_type, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), spans]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "task", "part", "whole", "n_turns", "formatted", "loss"])

        for b in batches:
            conv_type = b.schema.field(0).type
            for key, who, what in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if pieces and (key != last or size > part_chars):
                    closed(key == last)
                last = key
                piece, start, end = render_turn(who, what)
                if who in learned:
                    loss.append({"start": size + start, "end": size + end})
                pieces.append(piece)
                size += len(piece)
            if sum(len(r[5]) for r in rows_) > part_chars:
                yield batch()
        if pieces:
            closed(True)
        if rows_:
            yield batch()

    shape = f"conv_id {kind.simpleString()}, task long, part long, whole boolean, n_turns long, formatted string, loss {SPANS}"
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, shape)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """``(conv_id, task, part, turn, role, text, learned)``: the turns of formatted conversations, parsed, in order of ``(task, part, turn)``; ``learned`` says
    whether a turn's text is under the loss mask, as a whole."""

    @F.arrow_udf("array<struct<role:string,text:string,learned:boolean>>")
    def parsed(texts: pa.Array, loss: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts.to_pylist(), loss.to_pylist(), strict=True):
            under = {(s["start"], s["end"]) for s in spans}
            out.append([{"role": role, "text": what, "learned": (start, end) in under} for role, what, start, end in parse_turns(text)])
        return pa.array(out, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("learned", pa.bool_())])))

    rows = formatted.select("conv_id", "task", "part", F.posexplode(parsed("formatted", "loss")).alias("turn", "t"))
    return rows.select("conv_id", "task", "part", "turn", "t.role", "t.text", "t.learned")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` of each conversation, from its formatted text alone: the turns
    that the parser recovers (role, end of line, text, end of line of each), and the texts under the loss mask, unescaped.

    A conversation of one part is read where it stands; the parts of others meet, in order, in the task of their conversation, which
    takes them one after the other: what a digest needs of a conversation is its order, and what a task holds is one part."""
    kind = formatted.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        open_ = False
        key: object = None
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        for b in batches:
            rows: list[tuple] = []
            for k, text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if open_ and k != key:
                    rows.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    turns, loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                open_, key = True, k
                for role, what, _, _ in parse_turns(text):
                    turns.update(f"{role}\n{what}\n".encode())
                    n += 1
                for s in spans:
                    what = unescaped(text[s["start"] : s["end"]])
                    loss.update(what.encode())
                    loss_chars += len(what)
                chars += len(text)
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if open_:
            row = (key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)
            yield pa.record_batch([pa.array([c], t) for c, t in zip(row, kinds, strict=True)], names=names)

    shape = f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "formatted", "loss"]
    alone = formatted.where("whole").select(columns).mapInArrow(run, shape)
    parts = formatted.where("not whole").select(*columns, "task", "part").repartition("conv_id").sortWithinPartitions("conv_id", "task", "part")
    return alone.unionByName(parts.mapInArrow(run, shape))
