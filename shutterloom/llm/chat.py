"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens give, for each first turn, the last
one that fits the budget; the system turn leads every window, and a limited tail of the turns before the window is
repeated as context. Only assistant turns that are new in a window are under its loss mask, so each is learned once.
A turn that alone exceeds the budget has a window of its own; nothing is cut or dropped.

Turns are marked <|im_start|>role, newline, text, <|im_end|>, newline. Inside roles and texts a backslash is doubled
and <| is written <\\|, so no text can look like a mark and every text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import thrifty, tuned

#: Tokens of a window, and tokens of repeated history in it.
BUDGET, HISTORY = 1024, 256
#: Turns, and budgets of tokens, that are held before windows are cut; a longer conversation goes on with what is left.
BLOCK, HELD = 4096, 8
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def turn_tokens(role: str, text: str) -> int:
    """A bound on tokens that needs no vocabulary: four for the marks, one per started four bytes."""
    return 4 + -(-(len(role.encode()) + len(text.encode())) // 4)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of a window, as they were before formatting."""
    for m in _TURN.finditer(formatted):
        yield unescaped(m[1]), unescaped(m[2])


class _Conversation:
    """Cuts the turns of one conversation into windows as they come."""

    def __init__(self, key, budget: int, history: int, count: Callable[[str, str], int]):
        self.key, self.budget, self.history, self.count = key, budget, history, count
        self.system: tuple[str, str, int] | None = None
        self.turns: list[tuple[str, str, int]] = []
        self.past: list[tuple[str, str, int]] = []
        self.seen = self.windows = self.held = 0
        self.due, self.due_tokens = BLOCK, HELD * budget

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, self.count(role, text))
        if self.seen == 0 and role == "system":
            self.system = turn
        self.seen += 1
        self.turns.append(turn)
        self.held += turn[2]
        if len(self.turns) >= self.due or self.held >= self.due_tokens:
            yield from self.cut(last=False)
            # Where a window still grows, it is looked at again when twice as much is there.
            self.held = sum(t[2] for t in self.turns)
            self.due, self.due_tokens = len(self.turns) + max(BLOCK, len(self.turns)), max(HELD * self.budget, 2 * self.held)

    def cut(self, last: bool) -> Iterator[tuple]:
        """Windows over the turns at hand; the last one may still grow unless the conversation has ended."""
        total = np.concatenate(([0], np.cumsum([t[2] for t in self.turns])))
        at, n = 0, len(self.turns)
        while at < n:
            before = self.past + self.turns[:at]
            lead = [] if self.system is None or self.windows == 0 else [self.system]
            if lead and before and len(before) == 1 and before[0] is self.system:
                before = []
            room = self.budget - sum(t[2] for t in lead)
            kept, spent = [], 0
            for t in reversed(before):
                if t is self.system or spent + t[2] > self.history or spent + t[2] + self.turns[at][2] > room:
                    break
                kept.append(t)
                spent += t[2]
            end = max(int(np.searchsorted(total, total[at] + room - spent, "right")) - 1, at + 1)
            if end >= n and not last:
                break
            yield self.window(lead + kept[::-1], self.turns[at:end])
            at = end
        self.past = self.tail(self.past + self.turns[:at])
        self.turns = self.turns[at:]

    def tail(self, before: list[tuple]) -> list[tuple]:
        """The last turns whose tokens fit the history; no window repeats earlier ones."""
        k, spent = len(before), 0
        while k and spent + before[k - 1][2] <= self.history:
            k -= 1
            spent += before[k][2]
        return before[k:]

    def window(self, repeated: list[tuple], new: list[tuple]) -> tuple:
        parts, spans, size = [], [], 0
        for k, (role, text, _) in enumerate(repeated + new):
            head, body = f"{START}{escaped(role).replace(chr(10), chr(92) + 'n')}\n", escaped(text)
            if k >= len(repeated) and role == "assistant":
                spans.append({"start": size + len(head), "end": size + len(head) + len(body)})
            parts += (head, body, END, "\n")
            size += len(head) + len(body) + len(END) + 1
        self.windows += 1
        return self.key, self.windows - 1, len(repeated), len(new), sum(t[2] for t in repeated + new), "".join(parts), spans


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
WINDOWS = "window int, n_repeated int, n_new int, n_tokens long, text string, loss_spans array<struct<start: long, end: long>>"


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str, str], int] = turn_tokens) -> DataFrame:
    """(conv_id, window, n_repeated, n_new, n_tokens, text, loss_spans) of `turns` (conv_id, turn, role, text).

    Rows of a conversation are turns in ascending `turn`, null first; ties go by role, then text, and repeated rows
    are repeated turns. Null role or text counts as empty; a null conv_id is a conversation. loss_spans are code point
    offsets into text. The windows of a conversation follow each other in one partition, in order. A conversation's
    turns pass through one task, because its windows depend on those before, but only some budgets of them are held,
    besides a very long turn, which is a window of its own. Other columns are not read, so their names cannot clash. An
    empty table gives an empty table.
    """
    tuned(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    key_type = to_arrow_type(rows.schema["conv_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        for batch in batches:
            out: list[tuple] = []
            for key, role, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or key != now.key:
                    out += now.cut(last=True) if now else ()
                    now = _Conversation(key, budget, history, count)
                out += now.add(role, text)
            yield _windows(out, key_type)
        if now:
            yield _windows(list(now.cut(last=True)), key_type)

    return rows.mapInArrow(thrifty(run), f"conv_id {kind}, {WINDOWS}")


def _windows(out: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), _SPAN]
    columns = list(zip(*out, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "window", "n_repeated", "n_new", "n_tokens", "text", "loss_spans"])


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation: what reading its windows gives back, as counts and digests.

    `windows` as chat_windows() deals them. An empty table gives an empty table.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    key_kind = to_arrow_type(windows.schema["conv_id"].dataType)
    rows = windows.select("conv_id", "n_repeated", "text", "loss_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict | None = None

        def done() -> list[tuple]:
            return [(state["key"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"], state["windows"])] if state else []

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            kinds = [key_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * 7
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            out: list[tuple] = []
            for key, repeated, text, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or key != state["key"]:
                    out += done()
                    state = {"key": key, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "windows": 0}
                state["size"] += len(text)
                state["windows"] += 1
                for k, (role, said) in enumerate(read_turns(text)):
                    if k >= repeated:
                        state["turns"] += 1
                        state["all"].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learned = unescaped(text[span["start"] : span["end"]])
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
            yield batch_of(out)
        if state:
            yield batch_of(done())

    return rows.mapInArrow(thrifty(run), f"conv_id {kind}, {DIGESTS}")


def read_back_sql(turns: str, budget: int = BUDGET, history: int = HISTORY) -> str:
    """The result of read_back() over chat_windows() with turn_tokens(), in DuckDB's SQL; `turns` is a table or query with conv_id, turn, role and text.

    Where a window that starts at a turn ends, and where its history starts, follows from prefix sums alone; a recursion
    then steps from each conversation's first window to its next.
    """
    back, mark = "chr(92)", "'<|'"
    escapes = f"(length({{0}}) - length(replace({{0}}, {back}, ''))) + (length({{0}}) - length(replace({{0}}, {mark}, ''))) // 2"
    size = f"length(role) + {escapes.format('role')} + (length(role) - length(replace(role, chr(10), ''))) + length(text) + {escapes.format('text')} + {len(START) + len(END) + 2}"
    return f"""
    WITH RECURSIVE rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {turns}),
    numbered AS (
        SELECT *, row_number() OVER own AS i, 4 + CAST(ceil((octet_length(encode(role)) + octet_length(encode(text))) / 4.0) AS BIGINT) AS tokens, {size} AS chars FROM rows
        WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    summed AS (SELECT *, sum(tokens) OVER own AS upto, sum(chars) OVER own AS chars_upto FROM numbered WINDOW own AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
    leads AS (SELECT conv_id, tokens AS lead, chars AS lead_chars FROM summed WHERE i = 1 AND role = 'system'),
    starts AS (
        SELECT s.*, coalesce(lead, 0) AS lead, coalesce(lead_chars, 0) AS lead_chars, CASE WHEN lead IS NULL THEN 0 ELSE 1 END AS fixed,
        {budget} - CASE WHEN i > 1 THEN coalesce(lead, 0) ELSE 0 END AS room FROM summed s LEFT JOIN leads l ON s.conv_id IS NOT DISTINCT FROM l.conv_id),
    pasts AS (
        SELECT a.conv_id, a.i, max(b.tokens_back) AS spent, max(b.chars_back) AS spent_chars FROM starts a,
        LATERAL (SELECT a.upto - a.tokens - (b.upto - b.tokens) AS tokens_back, a.chars_upto - a.chars - (b.chars_upto - b.chars) AS chars_back FROM summed b
            WHERE b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i < a.i AND b.i > a.fixed AND a.upto - a.tokens - (b.upto - b.tokens) <= least({history}, a.room - a.tokens)) AS b
        GROUP BY a.conv_id, a.i),
    ends AS (
        SELECT a.conv_id, a.i, coalesce(p.spent_chars, 0) AS spent_chars, max(b.i) AS last, max(b.chars_upto) - (a.chars_upto - a.chars) AS new_chars,
        CASE WHEN a.i > 1 THEN a.lead_chars ELSE 0 END AS lead_chars
        FROM starts a LEFT JOIN pasts p ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.i = a.i
        JOIN summed b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i >= a.i AND (b.i = a.i OR b.upto - (a.upto - a.tokens) <= a.room - coalesce(p.spent, 0))
        GROUP BY a.conv_id, a.i, p.spent_chars, a.chars_upto, a.chars, a.lead_chars),
    windows AS (
        SELECT * FROM ends WHERE i = 1 UNION ALL
        SELECT e.* FROM windows w JOIN ends e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.last + 1),
    sizes AS (SELECT conv_id, CAST(sum(spent_chars + new_chars + lead_chars) AS BIGINT) AS formatted_chars, count(*) AS n_windows FROM windows GROUP BY conv_id),
    told AS (
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256
        FROM summed GROUP BY conv_id)
    SELECT t.*, formatted_chars, n_windows FROM told t JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM t.conv_id"""
