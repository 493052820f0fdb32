"""Chat formatting from a declarative template.

A finite-state machine over roles validates the order of turns. Each turn gives segments: its head, its text with
control strings escaped, and its end; a segment has a flag for the loss, which only covers texts of the template's
loss roles. Segments can be read back: the escape is reversible, and no text can contain a live control string.

Turns are shuffled by conversation, sorted, and streamed: a task holds one turn at a time, so memory does not grow
with a conversation. A conversation is one training sequence, whose digests are sequential, so it is in one task.

Defined results: null roles and texts are empty; a role without a head of its own is written in the template's
general head; an order that the machine refuses is counted in bad_turns, and the turns are written all the same;
turns that tie are ordered by role, then text, nulls first; repeated turns are all written; a row with a
null conv_id is a conversation of its own; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resight.llm.common import table


@dataclass(frozen=True)
class Template:
    heads: dict[str, str] = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    #: For other roles; {} is the role with all but letters, digits and -._~ as %XX.
    head: str = "### Role {}: "
    end: str = "</turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    #: Strings that no text may contain as they are. None may contain the escape.
    control: tuple[str, ...] = ("### System:", "### User:", "### Assistant:", "### Role ", "</turn>")
    escape: str = "\\"
    #: By state, the roles that may follow and the state they lead to.
    turns: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}})
    #: States in which a conversation may end.
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        if any(self.escape in c for c in self.control) or len(self.escape) != 1:
            raise ValueError("the escape is one character, which is in no control string")
        alternatives = "|".join(map(re.escape, self.control))
        object.__setattr__(self, "_live", re.compile(f"{re.escape(self.escape)}|(?=(?:{alternatives}))[\\s\\S]"))
        object.__setattr__(self, "_dead", re.compile(f"{re.escape(self.escape)}({re.escape(self.escape)}?)"))

    def opening(self, role: str) -> str:
        return self.heads.get(role) or self.head.format(quote(role, safe=""))

    def escaped(self, text: str) -> str:
        """Escapes are doubled; one goes after the first character of each control string, wherever it starts."""
        return self._live.sub(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        return self._dead.sub(lambda m: m[1], text)

    def read_turn(self, turn: str) -> tuple[str, str]:
        """(role, text) of one formatted turn without its end."""
        for role, head in self.heads.items():
            if turn.startswith(head):
                return role, self.unescaped(turn[len(head) :])
        before, after = self.head.split("{}")
        stop = turn.index(after, len(before))
        return unquote(turn[len(before) : stop]), self.unescaped(turn[stop + len(after) :])


DEFAULT = Template()
_SEGMENTS = "conv_id {id}, segment string, loss boolean, opens boolean, good boolean, final boolean, first boolean"


def segments(chats: DataFrame, template: Template = DEFAULT, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, segment, loss, opens (first segment of a turn), good (the turn's order), final (may end after it), first
    (of a conversation).

    Within its partition a conversation's rows are in order; shuffling them further loses that.
    """
    kind = chats.schema[conv_id].dataType.simpleString()
    rows = chats.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # rows of no conversation are dealt out, each by itself
    rows = rows.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    rows = rows.repartition("conv_id", "alone").sortWithinPartitions("conv_id", "alone", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), "start"
        for batch in batches:
            made: list[tuple] = []
            for conv, who, says in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if first := conv is None or conv != last:
                    last, state = conv, "start"
                good = who in template.turns.get(state, {})
                state = template.turns[state][who] if good else who if who in template.turns and who != "start" else state
                final = state in template.final
                for piece, loss, opens in ((template.opening(who), False, True), (template.escaped(says), who in template.loss, False), (template.end, False, False)):
                    made.append((conv, piece, loss, opens, good, final, first and opens))
            if made:
                columns = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column(0).type), pa.array(columns[1], pa.string()), *[pa.array(c, pa.bool_()) for c in columns[2:]]], names=["conv_id", "segment", "loss", "opens", "good", "final", "first"])

    return rows.mapInArrow(run, _SEGMENTS.format(id=kind))


class _Reader:
    """Reads one conversation's segments back."""

    def __init__(self, template: Template):
        self.template, self.buffer = template, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.bad = 0
        self.final = False

    def add(self, segment: str, loss: bool, opens: bool, good: bool, final: bool) -> None:
        self.chars += len(segment)
        if loss:
            plain = self.template.unescaped(segment)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.bad += opens and not good
        self.final = final
        self.buffer += segment
        while (at := self.buffer.find(self.template.end)) >= 0:
            role, text = self.template.read_turn(self.buffer[:at])
            self.buffer = self.buffer[at + len(self.template.end) :]
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.bad, self.bad == 0 and self.final


def read_back(made: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """A row for each conversation of segments(): what a reader of the formatted texts and loss flags finds."""
    kind = made.schema["conv_id"].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "bad_turns", "valid"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader, id_type = None, None, None
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names=["conv_id", *names])

        for part in batches:
            id_type = part.column(0).type
            for conv, *rest, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if first:
                    if reader is not None:
                        done.append((last, *reader.row()))
                    last, reader = conv, _Reader(template)
                reader.add(*rest)
            if len(done) > 1000:
                yield batch()
        if reader is not None:
            done.append((last, *reader.row()))
            yield batch()

    return made.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, bad_turns long, valid boolean")


PROBE = "\\### Assistant: </turn> ok"


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return read_back(segments(chats.unionByName(probe)))


_ESCAPED = "replace(t, '\\', '\\\\')"
for _c in DEFAULT.control:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
OP1_SQL = f"""
WITH c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
           UNION ALL SELECT -7, NULL, i, ['user', 'assistant'][i + 1], '{PROBE}' FROM range(2) AS x(i)),
o AS (SELECT *, lag(r) OVER w AS before, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, alone) AS n FROM c WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, r, t)),
f AS (SELECT *, CASE r WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE length('### Role : ' || url_encode(r)) END + length({_ESCAPED}) + {len(DEFAULT.end)} AS chars,
      coalesce(before, 'start') || '>' || r IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS good FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (NOT good) AS bad_turns,
       bool_and(good) AND bool_or(k = n AND r = 'assistant') AS valid
FROM f GROUP BY conv_id, alone
"""
