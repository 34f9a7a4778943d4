"""Chat formatting by event-sourced reconstruction: logs are partitioned by conversation, sorted by sequence,
and streamed deltas, edits and regenerations are folded into final messages, which are then rendered.

Events: conv_id, turn, tie, seq, event, role, text. ``open`` begins a message, ``delta`` adds to it, ``edit``
replaces what it holds, ``regenerate`` empties it. Sorted by conversation, turn, tie and seq a partition is
folded in one pass that holds one message at a time, however long a conversation is. ``rendered_turns`` deals events out by ranges
of these, so a conversation with a third of all rows lies in many tasks; ``read_back`` takes digests over whole conversations,
which only one task can do for each, but as a stream.

The template puts each turn between marks; a control string inside a text, of this template or of other
common ones, gets a backslash after its first character, and backslashes are doubled. Both are undone
when texts are read back.

Defined cases: a null text is empty; a null role is an empty one; a null conversation is one of its own; null
turns come first; rows of one conversation and turn follow each other by role, then by the text's SHA-256, and
repeated rows are turns of their own; an empty table gives no conversation; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, text_or_empty

DELTA_CHARS = 4096
#: What a message is before it is regenerated or edited, in a log made of finished conversations.
DRAFT = "draft [INST] "
#: Characters in which a formatted conversation is read back.
PIECE_CHARS = 1 << 16
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS]", "[/SYS]")}
#: Any other role: its name, then its text.
NAMED, NAME = ("[MSG]", "[/MSG]"), ("[ROLE]", "[/ROLE]")
#: Control strings of other templates, escaped too.
FOREIGN = ("<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
CONTROLS = sorted({m for pair in [*MARKS.values(), NAMED, NAME] for m in pair} | set(FOREIGN))
_STARTS = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"\[ROLE\](.*?)\[/ROLE\]\[MSG\](.*?)\[/MSG\]|\[INST\](.*?)\[/INST\]|<s>(.*?)</s>|\[SYS\](.*?)\[/SYS\]", re.S)


def escape(text: str) -> str:
    return _STARTS.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    if role in MARKS:
        return MARKS[role][0] + escape(text) + MARKS[role][1]
    return NAME[0] + escape(role) + NAME[1] + NAMED[0] + escape(text) + NAMED[1]


def parse(formatted: str) -> Iterator[tuple[str, str, tuple[int, int]]]:
    """(role, text, span of the escaped text) of each turn; anything outside turns is an error."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m[1] is not None:
            yield unescape(m[1]), unescape(m[2]), m.span(2)
        else:
            k = m.lastindex
            yield {3: "user", 4: "assistant", 5: "system"}[k], unescape(m[k]), m.span(k)


class Reader:
    """Turns out of a formatted conversation that comes in pieces of any size; holds one unfinished turn.

    A closing mark is looked for only in what is new, so a turn of many pieces takes time in proportion to its length.
    """

    OPENERS = {a: b for a, b in [*MARKS.values(), (NAME[0], NAMED[1])]}

    def __init__(self):
        self.held, self.size, self.tail = [], 0, ""

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in this piece."""
        self.held.append(piece)
        self.size += len(piece)
        # some closing mark must lie in the piece, or begin in the last characters before it
        near = self.tail + piece
        self.tail = near[-16:]
        if not any(close in near for close in self.OPENERS.values()):
            return
        text, at = "".join(self.held), 0
        while m := _TURN.match(text, at):
            at = m.end()
            if m[1] is not None:
                yield unescape(m[1]), unescape(m[2])
            else:
                yield {3: "user", 4: "assistant", 5: "system"}[m.lastindex], unescape(m[m.lastindex])
        self.held, self.size, self.tail = [text[at:]], len(text) - at, text[at:][-16:]

    def close(self) -> None:
        if self.size:
            raise ValueError(f"no turn in the last {self.size} characters")


def to_events(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as the log of a streaming client: open, then deltas.

    By the first digit of the text's digest, a third of the messages have first been drafted otherwise: the draft is then regenerated, or
    edited into the text's first part, to which deltas add the rest.
    """
    text = text_or_empty("text")
    rows = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
        F.sha2(text, 256).alias("digest"), F.monotonically_increasing_id().alias("row"),
    )
    # one pass over the text, however long it is
    parts = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA_CHARS}}}"), F.lit(0)), lambda p, i: F.struct((i + 3).alias("seq"), F.lit("delta").alias("event"), p.alias("text")))
    event = lambda seq, name, text: F.struct(F.lit(seq).alias("seq"), F.lit(name).alias("event"), text.alias("text"))
    start, draft, none = event(0, "open", F.lit("")), event(1, "delta", F.lit(DRAFT)), F.lit("")
    edited = F.concat(F.array(start, draft), F.transform(parts, lambda p, i: F.when(i == 0, p.withField("event", F.lit("edit"))).otherwise(p)))
    how = F.left("digest", F.lit(1))
    log = (
        F.when(how.isin(*"0123"), F.concat(F.array(start, draft, event(2, "regenerate", none)), parts))
        .when(how.isin("4", "5") & (F.col("text") != ""), edited).otherwise(F.concat(F.array(start), parts))
    )
    return rows.select("conv_id", "turn", F.struct("role", "digest", "row").alias("tie"), "role", F.explode(log).alias("e")).select("conv_id", "turn", "tie", "role", "e.*")


def fold(events: Iterator[tuple]) -> Iterator[tuple[object, str, str]]:
    """(conv_id, role, text) of each message, from sorted (conv_id, event, role, text)."""
    conv = role = parts = None
    for c, event, r, text in events:
        if event == "open":
            if parts is not None:
                yield conv, role, "".join(parts)
            conv, role, parts = c, r or "", []
        elif parts is None or c != conv:
            raise ValueError(f"{event} before open in conversation {c}")
        elif event == "delta":
            parts.append(text or "")
        elif event == "edit":
            parts = [text or ""]
        elif event == "regenerate":
            parts = []
        else:
            raise ValueError(f"unknown event {event}")
    if parts is not None:
        yield conv, role, "".join(parts)


def sorted_events(events: DataFrame, ranges: bool = False) -> DataFrame:
    """Partitions of whole conversations, or (ranges) of whole messages, each sorted."""
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie")]
    dealt = events.repartitionByRange(n, *by) if ranges else events.repartition(n, "conv_id")
    return dealt.sortWithinPartitions(*by, "seq")


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for b in batches:  # ids come as strings: pandas would turn whole numbers with nulls into floats
        yield from zip((None if pd.isna(c) else int(c) for c in b.conv_id), b.event, b.role, b.text, strict=True)


def rendered_turns(events: DataFrame, batch: int = 1000) -> DataFrame:
    """conv_id, position, role, formatted: the conversation's text is its turns joined in order of position.

    Positions grow within a conversation, but not by one: they count a task's messages, after those of the tasks before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        out, n = [], TaskContext.get().partitionId() << 40
        for conv, role, text in fold(_stream(batches)):
            out.append((conv, n, role, render(role, text)))
            n += 1
            if len(out) == batch:
                yield pd.DataFrame(out, columns=["conv_id", "position", "role", "formatted"]).astype({"conv_id": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "position", "role", "formatted"]).astype({"conv_id": "Int64"})

    small_batches(events.sparkSession)
    return sorted_events(events, ranges=True).select(F.col("conv_id").cast("string").alias("conv_id"), "event", "role", "text").mapInPandas(run, "conv_id long, position long, role string, formatted string")


def read_back(events: DataFrame) -> DataFrame:
    """Formats and reads the output back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Digests are taken turn by turn, so no conversation is ever held whole. The loss mask covers assistant texts.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, state, reader = [], None, Reader()

        def take(turns):
            for r, t in turns:
                state[1] += 1
                state[2].update(f"{r}\n{t}\n".encode())
                if r == "assistant":
                    state[3] += len(t)
                    state[4].update(t.encode())

        def close():
            if wait:
                take(reader.feed("".join(wait)))
                wait.clear()
            reader.close()
            conv, n, turns, chars, loss, size = state
            out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        wait, waiting = [], 0  # the joined output, read back in pieces that know nothing of turns
        for conv, role, text in fold(_stream(batches)):
            if state is None or state[0] != conv:
                if state is not None:
                    close()
                    if len(out) == 1000:
                        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
                        out.clear()
                state, reader, waiting = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], Reader(), 0
            formatted = render(role, text)
            state[5] += len(formatted)
            wait.append(formatted)
            waiting += len(formatted)
            if waiting >= PIECE_CHARS:
                joined = "".join(wait)
                whole = waiting - waiting % PIECE_CHARS
                for i in range(0, whole, PIECE_CHARS):
                    take(reader.feed(joined[i : i + PIECE_CHARS]))
                wait[:], waiting = [joined[whole:]], waiting - whole
        if state is not None:
            close()
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    small_batches(events.sparkSession)
    return sorted_events(events).select(F.col("conv_id").cast("string").alias("conv_id"), "event", "role", "text").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
