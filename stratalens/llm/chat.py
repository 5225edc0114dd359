"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns.  Prefix sums of the turns'
tokens, marks and escapes included, choose the longest span that fits ``BUDGET``
beside the system turn, which every window keeps, and a limited history: up to
``HISTORY_TURNS`` turns of at most ``HISTORY_TOKENS`` tokens before the span,
repeated.  Repeated turns are masked, so each assistant text is a target once.  A
turn that exceeds the budget alone has a window of its own; nothing is cut.

Turns are measured where they are, then sorted by conversation and turn; windows
are closed as the turns go by, so a task holds one window, however long the
conversation.

A turn is written ``<|role|>text</s>``.  Control strings inside roles and texts are
escaped by a backslash after their first character, and backslashes are doubled,
so no text can open or close a turn, and reading restores it exactly.

Turns are ordered by turn (nulls first), role and text; repeated rows are turns
like others.  Null roles and texts are empty.  A null ``conv_id`` is a conversation
of its own.  Only the first turn can be the system turn.  Extra columns are
ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import bpe
from stratalens.runtime import map_arrow, prepare

BUDGET = 1024
HISTORY_TURNS = 2
HISTORY_TOKENS = 256
OPEN, MID, CLOSE = "<|", "|>", "</s>"
#: Strings with a meaning in common chat templates; fixed values.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TURN = re.compile(r"<\|(.*?)\|>(.*?)</s>", re.S)
_BACK = re.compile(r"\\(.)", re.S)
WINDOWS = "window long, n_new long, n_repeated long, formatted string, loss array<struct<start:int,end:int>>"
#: The conversation that the query adds; it consists of control strings.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


Turn = tuple[str, str, int]


def mark(role: str, text: str) -> tuple[str, str]:
    """What a turn's window holds before ``CLOSE``: its head and its body."""
    return OPEN + escape(role) + MID, escape(text)


@dataclass
class Window:
    """Turns ``(role, text, tokens)`` of a window; only ``new`` ones are targets."""

    system: list[Turn]
    history: list[Turn]
    new: list[Turn] = field(default_factory=list)


def windows(turns: Iterable[Turn], budget: int = BUDGET) -> Iterator[Window]:
    """Windows of one conversation, each as soon as it is full."""
    system: list[Turn] = []
    last: list[Turn] = []
    now, total, start, first = None, 0, 0, True
    for turn in turns:
        if first and turn[0] == "system":
            system, first = [turn], False
            continue
        first = False
        room = budget - sum(t[2] for t in system)
        if now is None or total + turn[2] - start > room:
            if now is not None:
                yield now
            past = last[-HISTORY_TURNS:]
            while past and (sum(t[2] for t in past) > HISTORY_TOKENS or sum(t[2] for t in past) + turn[2] > room):
                past = past[1:]
            # ``start`` is the prefix sum at which the window's history begins
            now, start = Window(system, past), total - sum(t[2] for t in past)
        now.new.append(turn)
        total += turn[2]
        last = [*last, turn][-HISTORY_TURNS:]
    if now is not None or system:
        yield now or Window(system, [])


def format_window(w: Window) -> tuple[str, list[dict]]:
    """Text of a window, and the spans of code points under the loss mask."""
    text, loss, at = [], [], 0
    fresh = len(w.system) + len(w.history)
    for k, (role, said, _) in enumerate([*w.system, *w.history, *w.new]):
        before, body = mark(role, said)
        at += len(before)
        if role == "assistant" and k >= fresh:
            loss.append({"start": at, "end": at + len(body)})
        at += len(body) + len(CLOSE)
        text += [before, body, CLOSE]
    return "".join(text), loss


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Rows of each run of equal first values, as they come."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, lambda row: row[0])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 64) -> Iterable[pa.RecordBatch]:
    while part := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def format_conversations(rows: DataFrame, budget: int = BUDGET, ranks: str | None = None) -> DataFrame:
    """``(conv_id, window, n_new, n_repeated, formatted, loss)`` of
    ``rows(conv_id, turn, role, text)``; the windows of a conversation are in one
    partition, together and in order."""
    spark = prepare(rows.sparkSession)
    raw = spark.sparkContext.broadcast(bpe.rank_file(ranks))
    told = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoding = bpe.load(raw.value)
        sizes = [bpe.encode(encoding, "".join(mark(r, t)) + CLOSE).size for r, t in zip(*(batch.column(i).to_pylist() for i in (2, 3)))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*batch.schema.names, "size"])

    kinds = {f.name: f.dataType.simpleString() for f in told.schema}
    sized = map_arrow(told, measure, ", ".join(f"{c} {kinds[c]}" for c in told.columns) + ", size long")
    ordered = sized.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text", "size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        loss = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        own = [("conv_id", first.schema.field(0).type), ("window", pa.int64()), ("n_new", pa.int64()), ("n_repeated", pa.int64()), ("formatted", pa.string()), ("loss", loss)]

        def rows() -> Iterator[tuple]:
            for conv, turns in _runs(chain([first], batches)):
                for i, w in enumerate(windows((t[1:] for t in turns), budget)):
                    new = len(w.new) + (len(w.system) if i == 0 else 0)
                    yield (conv, i, new, len(w.system) + len(w.history) + len(w.new) - new, *format_window(w))

        yield from _batches(rows(), pa.schema(own))

    return ordered.mapInArrow(run, f"conv_id {kinds['conv_id']}, {WINDOWS}")


def summarize(formatted: DataFrame) -> DataFrame:
    """What each conversation's windows say, read back from them.  The windows of
    a conversation must lie together and in order, as they are made; digests are
    taken as they go by."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    rows_in = formatted.select("conv_id", "n_repeated", "formatted", "loss")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return

        def rows() -> Iterator[tuple]:
            for conv, found in _runs(chain([first], batches)):
                told, target = hashlib.sha256(), hashlib.sha256()
                turns = goal = chars = count = 0
                for _, repeated, text, loss in found:
                    for role, said in _TURN.findall(text)[repeated:]:
                        told.update(f"{unescape(role)}\n{unescape(said)}\n".encode())
                        turns += 1
                    for span in loss:
                        said = unescape(text[span["start"] : span["end"]])
                        target.update(said.encode())
                        goal += len(said)
                    chars += len(text)
                    count += 1
                yield conv, turns, told.hexdigest(), goal, target.hexdigest(), chars, count

        yield from _batches(rows(), pa.schema([("conv_id", first.schema.field(0).type), *zip(names, kinds)]))

    return rows_in.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op7(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    extra = rows.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return summarize(format_conversations(rows.unionByName(extra)))
