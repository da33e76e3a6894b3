"""Chat formatting in budgeted windows of whole turns.

Prefix sums of turn tokens choose the spans: those held of the turns that a
window may still hold give, by one difference, whether another turn fits the
budget after the system turn and the repeated history, and by one bisection, how
much history fits before a window's first new turn.  Targets are the assistants'
texts; a repeated turn is outside the loss mask, so each target counts once.  A
turn that alone exceeds the budget gets a window of its own, whole.

Every control string inside a text or a role gets one backslash more after its
first character, so that it is no control string any longer; reading back takes
it away.  Conversations are sorted within their partition and streamed turn by
turn: memory holds one window and its history, however long the conversation; one
conversation is one task's, as its windows follow from one another.

Defined results: a null text or role is empty; turns order by number (null
first), then role, then text, and repeated rows are turns of their own; a null
conv_id is one conversation; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this template and of others that may be mixed with it.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(rf"(?<={re.escape(c[0])})\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(c[0])})\\+{re.escape(c[1:])}" for c in CONTROLS))
_TOKEN = re.compile(r"\w+|[^\w\s]")
#: Tokens that a turn's markers take.
TURN_TOKENS = 4
WINDOW_DDL = "conv_id long, window int, text string, repeated int, loss array<struct<start:bigint,end:bigint>>"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][1:], text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


def count_tokens(text: str) -> int:
    """Words and marks; a stand-in for a tokenizer that needs no file on the executors."""
    return sum(1 for _ in _TOKEN.finditer(text)) + TURN_TOKENS


_LOADED: dict[str, object] = {}


def token_counter(tokenizer: str | None) -> Callable[[str], int]:
    """Counts the tokens of a turn: by count_tokens, or by a tokenizer file that all executors can open."""
    if tokenizer is None:
        return count_tokens

    def count(text: str) -> int:
        if tokenizer not in _LOADED:
            from tokenizers import Tokenizer

            _LOADED[tokenizer] = Tokenizer.from_file(tokenizer)
            _LOADED[tokenizer].encode_special_tokens = True
        return len(_LOADED[tokenizer].encode(text, add_special_tokens=False).ids) + TURN_TOKENS

    return count


class Windows:
    """The windows of one conversation, turn by turn.

    Held are the turns that the open window shows or may repeat, and the prefix
    sums of their tokens: turns[start:new] are its history, turns[new:] its own.
    """

    def __init__(self, budget: int, history: int, count: Callable[[str], int] = count_tokens) -> None:
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple[tuple[str, str], int] | None = None  # with its tokens; leads every window but the first, whose own turn it is
        self.turns: list[tuple[str, str]] = []
        self.sums = [0]
        self.start = self.new = self.made = 0

    def _lead(self) -> int:
        """Tokens of the system turn that leads the open window."""
        return self.system[1] if self.system and self.made else 0

    def add(self, role: str, text: str) -> tuple | None:
        """Takes a turn; gives the window that it closes, if any."""
        tokens = self.count(text)
        out = None
        if len(self.turns) > self.new and self._lead() + self.sums[-1] - self.sums[self.start] + tokens > self.budget:
            out = self.close()
        if not self.made and not self.turns and role == "system":
            self.system = (role, text), tokens
        if self.made and len(self.turns) == self.new:
            room = max(min(self.history, self.budget - self._lead() - tokens), 0)
            self.start = bisect_left(self.sums, self.sums[-1] - room)
        self.turns.append((role, text))
        self.sums.append(self.sums[-1] + tokens)
        return out

    def close(self) -> tuple:
        """(window, text, repeated turns, loss spans) of the open window; what can be repeated stays."""
        lead = [self.system[0]] if self.system and self.made else []
        repeated = len(lead) + self.new - self.start
        parts, loss, at = [], [], 0
        for i, (role, text) in enumerate((*lead, *self.turns[self.start :])):
            head, body = f"{OPEN}{_role_out(role)}\n", escape(text)
            if i >= repeated and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            parts += [head, body, CLOSE]
            at += len(head) + len(body) + len(CLOSE)
        out = (self.made, "".join(parts), repeated, loss)
        kept = max(bisect_left(self.sums, self.sums[-1] - self.history), 1 if self.system and not self.made else 0)
        self.turns, self.sums = self.turns[kept:], [s - self.sums[kept] for s in self.sums[kept:]]
        self.start = self.new = len(self.turns)
        self.made += 1
        return out


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 256, tokenizer: str | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) as windows: conv_id, window, text, repeated, loss.

    Budget and history are in tokens, of a tokenizer file where one is given.

    The first ``repeated`` turns of a window were in earlier ones; loss holds
    the spans of the text, in code points, that are targets.  Windows of a
    conversation stand together in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run  # no conversation yet
        state, count = None, token_counter(tokenizer)
        ready: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True))
            ready.clear()
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "window", "text", "repeated", "loss"])

        for batch in batches:
            for who, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if who != conv or state is None:
                    if state is not None:
                        ready.append((conv, *state.close()))
                    conv, state = who, Windows(budget, history, count)
                if (made := state.add(role, text)) is not None:
                    ready.append((conv, *made))
                if len(ready) >= 256:
                    yield flushed()
        if state is not None:
            ready.append((conv, *state.close()))
        if ready:
            yield flushed()

    blank = F.lit("")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, WINDOW_DDL)


def parse_window(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    at = 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(CLOSE, line + 1)
        yield _role_in(text[at + len(OPEN) : line]), unescape(text[line + 1 : end])
        at = end + len(CLOSE)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of conversations, from the windows of format_conversations alone, in whatever order they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = run
        turns = chars = loss_chars = 0
        said, loss = hashlib.sha256(), hashlib.sha256()
        ready: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True))
            ready.clear()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for who, window, text, repeated, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "text", "repeated", "loss")), strict=True):
                if window == 0:
                    if conv is not run:
                        ready.append((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    conv, turns, chars, loss_chars = who, 0, 0, 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                for i, (role, body) in enumerate(parse_window(text)):
                    if i >= repeated:
                        turns += 1
                        said.update(f"{role}\n{body}\n".encode())
                for s in spans:
                    body = unescape(text[s["start"] : s["end"]])
                    loss_chars += len(body)
                    loss.update(body.encode())
                if len(ready) >= 1024:
                    yield flushed()
        if conv is not run:
            ready.append((conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if ready:
            yield flushed()

    ordered = windows.select("conv_id", "window", "text", "repeated", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
