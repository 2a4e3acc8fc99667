"""Chat formatting in budgeted windows.

Turns of a conversation are laid out in order in windows of at most ``budget`` tokens. Prefix sums of turn tokens choose
turn-aligned spans: a window repeats the leading system turn and as many of the turns before its span as fit into
``history`` tokens, then takes new turns while they fit, one at least (a turn that is larger than the budget has a
window with nothing repeated but the system turn). Loss counts on assistant turns, in the window in which they are new.

Template: each turn is ``<s>[INST] role``, a line break, the text, a line break, ``[/INST]</s>``, a line break. A control
string inside a text gets one more backslash before it than it has, and an unescaped one is never inside a text, so the
output can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.shared import table, written

BUDGET, HISTORY = 512, 128
OPEN, CLOSE = "<s>[INST] ", "\n[/INST]</s>\n"
_CONTROL = r"</?s>|\[/?INST\]"
_ESCAPE = re.compile(rf"\\*(?:{_CONTROL})")
_UNESCAPE = re.compile(rf"\\(\\*(?:{_CONTROL}))")
_TURN = re.compile(r"<s>\[INST\] ([^\n]*)\n")
WINDOW_SQL = "window long, text string, n_repeated long, n_tokens long, loss array<struct<start:long,end:long>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    head = f"{OPEN}{quote(role, safe=' ')}\n"
    inner = escape(text)
    return head + inner + CLOSE, len(head), len(head) + len(inner)


def parse(window: str) -> list[tuple[str, str]]:
    """role, text of each turn of a window."""
    out, at = [], 0
    while at < len(window):
        head = _TURN.match(window, at)
        end = window.index(CLOSE, head.end() - 1)
        out.append((unquote(head[1]), unescape(window[head.end() : end] if end >= head.end() else "")))
        at = end + len(CLOSE)
    return out


def count_words(text: str) -> int:
    """Tokens of a text where no tokenizer is given: its words."""
    return len(text.split())


class _Windows:
    """Makes one conversation's windows from its turns in order; keeps the open window and the history only."""

    def __init__(self, budget: int, history: int, tokens: Callable[[str], int]):
        self.budget, self.history, self.tokens = budget, history, tokens
        self.system: tuple[str, str, int] | None = None
        self.shown: list[tuple[str, str, int]] = []  # the newest turns before the open window
        self.new: list[tuple[str, str, int]] = []
        self.size = 0
        self.number = 0
        self.any = False

    def add(self, role: str, text: str) -> Iterator[dict]:
        one = (role, text, self.tokens(text) + 4)
        if not self.any and role == "system":
            self.any, self.system = True, one
            return
        self.any = True
        if self.new and self.size + one[2] > self.budget:
            yield self._close()
        if not self.new:
            self._start(one[2])
        self.new.append(one)
        self.size += one[2]

    def _start(self, first: int) -> None:
        fixed = self.system[2] if self.system else 0
        room, kept = min(self.history, self.budget - fixed - first), []
        for t in reversed(self.shown):
            if t[2] > room:
                break
            kept.append(t)
            room -= t[2]
        self.shown = kept[::-1]
        self.size = fixed + sum(t[2] for t in self.shown)

    def _close(self) -> dict:
        repeated = [self.system] * bool(self.system) + self.shown
        text, loss, at = [], [], 0
        for i, (role, said, _) in enumerate([*repeated, *self.new]):
            whole, start, end = turn(role, said)
            text.append(whole)
            if role == "assistant" and i >= len(repeated):
                loss.append({"start": at + start, "end": at + end})
            at += len(whole)
        # the system turn is new in the first window
        n = len(repeated) - bool(self.system and self.number == 0)
        out = {"window": self.number, "text": "".join(text), "n_repeated": n, "n_tokens": self.size, "loss": loss}
        self.number += 1
        recent, room = [], self.history
        for t in reversed([*self.shown, *self.new]):
            room -= t[2]
            if room < 0:
                break
            recent.append(t)
        self.shown, self.new, self.size = recent[::-1], [], 0
        return out

    def finish(self) -> Iterator[dict]:
        if self.new or (self.system and self.number == 0):
            if not self.new:
                self.size = self.system[2]
            yield self._close()


def _format(budget: int, history: int, tokens: Callable[[str], int]):
    """conv_id, role, text in order -> windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out, size = object(), None, [], 0
        for batch in batches:
            kind = batch.schema.field(0).type

            def flush(rows=None, kind=kind):
                schema = pa.schema([("conv_id", kind), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int64()), ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
                return pa.RecordBatch.from_pylist(rows, schema)

            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        out += [{"conv_id": now, **w} for w in state.finish()]
                    now, state = conv, _Windows(budget, history, tokens)
                for w in state.add(role, text):
                    out.append({"conv_id": now, **w})
                    size += len(w["text"])
                if len(out) >= 2000 or size > 16_000_000:
                    yield flush(out)
                    out, size = [], 0
        if state is not None:
            out += [{"conv_id": now, **w} for w in state.finish()]
            yield flush(out)

    return run


def format_windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[str], int] = count_words
) -> DataFrame:
    """conv_id, window, text, n_repeated (turns at the window's start that an earlier window has too), n_tokens, loss (spans
    of text under the loss mask, in code points, end exclusive).

    conversations: conv_id, turn, role, text. Null texts and roles are empty; a null turn comes first; turns with equal
    numbers stand in order of role and text, repeated rows each as a turn. A conversation is read once, in order, by one
    task, which holds one window of it at a time. An empty table gives no windows. Other columns are ignored.
    """
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_format(budget, history, tokens), f"conv_id {kind}, {WINDOW_SQL}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows in order -> digests of each conversation's turns and of the text under its loss mask."""
    now, state, out = None, None, []

    def done() -> None:
        turns, loss, n, chars, formatted = state
        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

    for batch in batches:
        kind = batch.schema.field(0).type
        for conv, text, repeated, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != now:
                if state is not None:
                    done()
                now, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            for role, said in parse(text)[repeated:]:
                state[0].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                state[2] += 1
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                state[1].update(said.encode("utf-8", "surrogatepass"))
                state[3] += len(said)
            state[4] += len(text)
    if state is not None:
        done()
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows alone."""
    n = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = windows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "window")
    kind = windows.schema["conv_id"].dataType.simpleString()
    return rows.select("conv_id", "text", "n_repeated", "loss").mapInArrow(
        _read,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    two = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"),
    )
    return read_back(written(format_windows(rows.unionByName(two)), "windows"))
