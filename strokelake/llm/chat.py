"""Chat formatting into budgeted training windows.

A conversation is formatted turn by turn. Prefix sums of the turns' token counts choose spans that begin and end at turns and
fit a budget together with the system turn; every window after the first repeats some history, whose targets are masked, so
each assistant turn is trained on exactly once. Turns stream through in order: a conversation is never held as a whole, only
its system turn and the last few turns that the next window may repeat.

Template: ``[SYS]text[/SYS]``, ``[INST]text[/INST]`` and ``[ASST]text</s>`` for system, user and assistant, and
``[ROLE]name[/ROLE][INST]text[/INST]`` for any other role. Inside texts and role names a backslash becomes ``\\b``, ``[``
becomes ``\\s`` and ``<`` becomes ``\\l``: no control string can stand there, and the escaping reads back exactly.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import vocabulary
from .tokens import count_udf

#: (before the text, after the text) by role.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ASST]", "</s>")}


#: What stands for the characters that begin control strings, the escape character itself first.
ESCAPES = (("\\", "\\b"), ("[", "\\s"), ("<", "\\l"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_turns(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per turn: ``conv_id, turn, role, head, body, tail, target, n_tokens``; head + body + tail is the formatted turn.

    Null texts and roles are empty strings. ``n_tokens`` is the tokenizer's count for the formatted turn by itself.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    pick = lambda k: F.coalesce(*[F.when(role == r, F.lit(m[k])) for r, m in MARKS.items()], F.lit(MARKS["user"][k]))
    known = role.isin(*MARKS)
    head = F.concat(F.when(known, F.lit("")).otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"))), pick(0))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), head.alias("head"), escape(text).alias("body"), pick(1).alias("tail"), (role == "assistant").alias("target"))
    return rows.withColumn("n_tokens", count_udf(tokenizer_path)(F.concat("head", "body", "tail")))


class Turn(NamedTuple):
    role: str
    head: str
    body: str
    tail: str
    target: bool
    n_tokens: int


class Windows:
    """Chooses the windows of one conversation turn by turn: greedy spans of prefix sums.

    The leading system turn stands in every window and takes its part of the budget; one that takes all of it is shown in the
    first window only. A turn that doesn't fit into what is left gets a window of its own, uncut, which is then over budget.
    """

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.room, self.system, self.window, self.used = budget, None, -1, 0
        self.last: deque = deque(maxlen=history)

    def push(self, row: Turn) -> list[tuple[int, Turn, bool]]:
        """(window, turn, new) for a turn and what is repeated before it."""
        size, out = row.n_tokens, []
        if self.window < 0 and self.system is None and row.role == "system":
            self.system, self.window, self.room = row, 0, self.budget - size
            if self.room <= 0:
                self.room, self.system, self.used = self.budget, False, self.budget  # the first window is full
            return [(0, row, True)]
        if self.window < 0 or self.used and self.used + size > self.room:
            self.window += 1
            repeated = list(self.last)
            while repeated and sum(r.n_tokens for r in repeated) + size > self.room:
                repeated.pop(0)  # less history rather than no progress
            self.used = sum(r.n_tokens for r in repeated)
            out = [(self.window, r, False) for r in ([self.system] if self.system else []) + repeated]
        self.used += size
        self.last.append(row)
        return [*out, (self.window, row, True)]


class Window:
    """A window as it fills: its text, where its new part begins, and its loss spans."""

    def __init__(self, number: int):
        self.number, self.parts, self.size, self.fresh, self.n_tokens, self.spans = number, [], 0, 0, 0, []

    def add(self, turn: Turn, new: bool) -> None:
        begin = self.size + len(turn.head)
        if new and turn.target:
            self.spans.append((begin, begin + len(turn.body)))
        self.parts += turn.head, turn.body, turn.tail
        self.size = begin + len(turn.body) + len(turn.tail)
        self.fresh += 0 if new else self.size - self.fresh
        self.n_tokens += turn.n_tokens


SPANS = "array<struct<start: int, end: int>>"


def windows_of(formatted: DataFrame, budget: int, history: int) -> DataFrame:
    """``conv_id, window, text, fresh, n_tokens, spans``: turns in order go through a task, and each window leaves when it is full."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "body").select("conv_id", *Turn._fields)
    names = ["conv_id", "window", "text", "fresh", "n_tokens", "spans"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]

    def batch_of(done: list[tuple]) -> pa.RecordBatch:
        rows = [(c, w.number, "".join(w.parts), w.fresh, w.n_tokens, [{"start": a, "end": b} for a, b in w.spans]) for c, w in done]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    def run(batches):
        conversation, chooser, open_window = object(), None, None
        for batch in batches:
            done = []
            for key, *fields in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if chooser is None or key != conversation:
                    if open_window:
                        done.append((conversation, open_window))
                    conversation, chooser, open_window = key, Windows(budget, history), None
                for number, turn, new in chooser.push(Turn(*fields)):
                    if open_window is None or open_window.number != number:
                        if open_window:
                            done.append((conversation, open_window))
                        open_window = Window(number)
                    open_window.add(turn, new)
            yield batch_of(done)
        if open_window:
            yield batch_of([(conversation, open_window)])

    return ordered.mapInArrow(run, f"conv_id long, window int, text string, fresh int, n_tokens long, spans {SPANS}")


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 2, tokenizer_path: str | None = None) -> DataFrame:
    """One row per training window: ``conv_id, window, text, fresh, n_tokens, over_budget, spans``.

    ``text`` is the leading system turn, up to ``history`` turns that the window before showed, and from the code point ``fresh``
    on the window's new turns; ``spans`` are the new assistant texts in it (code points, end excluded), all else is masked.
    ``n_tokens`` is the sum of the turns' counts by the tokenizer, at most ``budget`` but for a turn that is longer than what
    the system turn leaves: it stands uncut as the only new turn of its window, and ``over_budget`` tells so. A system turn that
    leaves nothing stands alone in the first window and isn't repeated.

    Rows are ordered by turn, then role and text, so repeated rows and ties give one defined result; null turns come first;
    null texts are empty; rows with a null conv_id form a conversation of their own; other columns are not read; an empty
    table gives an empty result.
    """
    formatted = format_turns(turns, tokenizer_path or vocabulary("byte_bpe_50k.json"))
    made = windows_of(formatted, budget, history)
    return made.select("conv_id", "window", "text", "fresh", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"), "spans")


#: A formatted turn: the name of an unusual role, the mark, the text. Texts hold no bare [ or <.
_TURN = r"(\[ROLE\][^\[<]*+\[/ROLE\])?\[(SYS|INST|ASST)\]([^\[<]*+)(?:\[/SYS\]|\[/INST\]|</s>)"


def read_back(windows: DataFrame) -> DataFrame:
    """Turns and loss text of whole conversations from their windows: ``conv_id, turns (array of role, text), loss_text, formatted_chars``.

    Turns and characters are those of the windows' new parts, one after the other; the loss text is that under the masks,
    unescaped, in order. A conversation becomes one row, so this is for checks and digests, not for training.
    """
    part = lambda k: F.regexp_extract_all("new_text", F.lit(_TURN), F.lit(k))
    under = F.array_join(F.transform("spans", lambda s: F.substring("text", s["start"] + 1, s["end"] - s["start"])), "")
    rows = windows.select("conv_id", "window", F.substring("text", F.col("fresh") + 1, F.length("text")).alias("new_text"), unescape(under).alias("loss"))
    rows = rows.withColumn("_turns", F.arrays_zip(part(1).alias("name"), part(2).alias("mark"), part(3).alias("body")))
    usual = lambda mark: F.when(mark == "SYS", "system").when(mark == "ASST", "assistant").otherwise("user")
    turns = F.transform("_turns", lambda t: F.struct(F.when(t["name"] != "", unescape(F.substring(t["name"], F.lit(7), F.length(t["name"]) - 13))).otherwise(usual(t["mark"])).alias("role"), unescape(t["body"]).alias("text")))
    rows = rows.select("conv_id", F.struct("window", turns.alias("turns"), "loss", F.length("new_text").cast("long").alias("chars")).alias("w"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"), F.sum("w.chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten("w.turns").alias("turns"), F.array_join("w.loss", "").alias("loss_text"), "formatted_chars")
