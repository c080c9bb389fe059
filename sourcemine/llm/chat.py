"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, only its text trainable.  The contexts of one conversation are
prefixes of one formatted text, so that text is written once, turn by turn, and
an example is a row of a second table: its number, the end of its context, the
span of its target and the SHA-256 of its context, all in characters of the
conversation.  Reading follows these rows and checks each context against the
prefix it names.  Written out in full the same contexts would grow with the
square of a conversation; ``expanded`` does that for those who want the strings.

A turn is ``<turn>ROLE<says>TEXT</turn>`` and a newline.  Inside role and text a
backslash goes before each ``\\`` and ``<``, so no text can hold a mark, and
taking it away gives the text back.

Turns are ordered by ``turn`` (null first), then role, then text.  A null text
or role counts as empty.  Rows without a conversation id form one conversation
of their own.  Repeated rows are turns each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcemine.llm.common import stored

OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>\n"
TRAINED_ROLE = "assistant"
_TURN = re.compile(r"<turn>((?:[^\\<]|\\.)*)<says>((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def formatted(turns: DataFrame) -> DataFrame:
    """One row a turn: ``conv_id, turn, formatted`` and the span of characters
    ``loss_start, loss_length`` in it that is trained on (length null: none).

    A row with a span is the example of that turn; its context is ``formatted``
    of all rows before it in the conversation.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit(SAYS))
    trained = role == TRAINED_ROLE
    return turns.select(
        "conv_id",
        "turn",
        F.concat(head, escaped(text), F.lit(CLOSE)).alias("formatted"),
        F.when(trained, F.length(head)).cast("long").alias("loss_start"),
        F.when(trained, F.length(escaped(text))).cast("long").alias("loss_length"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Whole conversations in one partition each, their turns in order; rows of one
    turn by role and text as they were before the escapes."""
    head = F.regexp_extract("formatted", rf"(?s)^{OPEN}((?:[^\\<]|\\.)*){SAYS}", 0)
    role = F.substr("formatted", F.lit(len(OPEN) + 1), F.length(head) - len(OPEN) - len(SAYS))
    length = F.length("formatted") - F.length(head) - len(CLOSE)
    text = F.substr("formatted", F.length(head) + 1, length)
    plain = [F.regexp_replace(part, r"(?s)\\(.)", "$1") for part in (role, text)]
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", *plain)


def placed(rows: DataFrame) -> DataFrame:
    """Formatted turns with the character at which each starts in its
    conversation (``start``), the number of its example and the SHA-256 of the
    text before it (both null: not an example)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, n, context, first = None, 0, 0, hashlib.sha256(), True
        for batch in batches:
            starts, numbers, sums = [], [], []
            for conv, line, length in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if first or conv != key:
                    key, at, n, context, first = conv, 0, 0, hashlib.sha256(), False
                starts.append(at)
                numbers.append(None if length is None else n)
                sums.append(None if length is None else context.hexdigest())
                n += length is not None
                at += len(line)
                context.update(line.encode("utf-8", "surrogatepass"))
            more = [pa.array(starts, pa.int64()), pa.array(numbers, pa.int64()), pa.array(sums, pa.string())]
            names = [*batch.schema.names, "start", "example", "context_sha256"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    kind = dict(rows.dtypes)["conv_id"]
    columns = in_order(rows).select("conv_id", "formatted", "loss_start", "loss_length")
    return columns.mapInArrow(
        place,
        f"conv_id {kind}, formatted string, loss_start bigint, loss_length bigint,"
        " start bigint, example bigint, context_sha256 string",
    )


def written(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The output of a run from formatted turns, stored and read back: the
    conversations ``conv_id, start, formatted``, and one row an example:
    ``conv_id, example, context_end, context_sha256, target_start,
    target_length``."""
    lines = stored(placed(rows), "chat")
    examples = lines.where("example IS NOT NULL").select(
        "conv_id",
        "example",
        F.col("start").alias("context_end"),
        "context_sha256",
        (F.col("start") + F.col("loss_start")).alias("target_start"),
        F.col("loss_length").alias("target_length"),
    )
    return lines.select("conv_id", "start", "formatted"), stored(examples, "chat-examples")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class _Digest:
    """What the rows of one conversation say, without holding them."""

    def __init__(self):
        self.turns, self.loss, self.context = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_examples = 0
        self.target: tuple[int, int] | None = None

    def example(self, number: int, end: int, checksum: str, start: int, length: int) -> None:
        if self.target is not None or number != self.n_examples:
            raise ValueError(f"example {number} follows {self.n_examples} others")
        if end != self.chars or checksum != self.context.hexdigest():
            raise ValueError(f"the context of example {number} is not a prefix of its conversation")
        self.target = start - end, length
        self.n_examples += 1

    def turn(self, at: int, line: str) -> None:
        turn = _TURN.fullmatch(line)
        if turn is None or at != self.chars:
            raise ValueError("not a formatted turn at its place")
        role, text = (unescaped(x) for x in turn.groups())
        if (self.target is not None) != (role == TRAINED_ROLE):
            raise ValueError(f"not one example for each turn of {TRAINED_ROLE}")
        if self.target is not None:
            if self.target != (turn.start(2), len(turn[2])):
                raise ValueError("a target is not the text of its turn")
            start, length = self.target
            target = unescaped(line[start : start + length])
            self.loss.update(target.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(target)
            self.target = None
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.context.update(line.encode("utf-8", "surrogatepass"))
        self.n_turns += 1
        self.chars += len(line)

    def result(self) -> tuple:
        if self.target is not None:
            raise ValueError("an example without its target")
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


NAMES = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digests(rows: DataFrame) -> DataFrame:
    """``read_digests`` of the output for formatted turns."""
    return read_digests(*written(rows))


def read_digests(lines: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation, read from the output: its turns, and all text under the
    loss masks of its examples.  Fails if an example's context is not the prefix
    it names, or its target not the text of the turn behind.  A digest runs
    through a conversation turn by turn, so one task reads it, but keeps no more
    than a batch."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, key, state = pa.int64(), None, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[] for _ in NAMES]
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], NAMES)

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for conv, at, line, *example in zip(*(column.to_pylist() for column in batch.columns)):
                if state is None or conv != key:
                    if state is not None:
                        done.append((key, *state.result()))
                    key, state = conv, _Digest()
                if line is None:
                    number, *rest = example
                    state.example(number, at, *rest)
                else:
                    state.turn(at, line)
            yield batch_of(done)
        if state is not None:
            yield batch_of([(key, *state.result())])

    kind = dict(lines.dtypes)["conv_id"]
    own = ["example", "context_sha256", "target_start", "target_length"]
    both = lines.unionByName(
        examples.select("conv_id", F.col("context_end").alias("start"), *own), allowMissingColumns=True
    )
    # An example comes before the turn that starts where its context ends.
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "start", F.col("example").asc_nulls_last())
    return ordered.select("conv_id", "start", "formatted", *own).mapInArrow(
        read,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def expanded(rows: DataFrame) -> DataFrame:
    """The examples as strings: ``conv_id, example, text, loss_start,
    loss_length``.  The output is as large as all contexts together."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, context, n, first = None, "", 0, True
        for batch in batches:
            for conv, line, start, length in zip(*(column.to_pylist() for column in batch.columns)):
                if first or conv != key:
                    key, context, n, first = conv, "", 0, False
                if length is not None:
                    values = [[conv], [n], [context + line], [len(context) + start], [length]]
                    types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    arrays = [pa.array(v, t) for v, t in zip(values, types)]
                    names = ["conv_id", "example", "text", "loss_start", "loss_length"]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    n += 1
                context += line
        return

    kind = dict(rows.dtypes)["conv_id"]
    columns = in_order(rows).select("conv_id", "formatted", "loss_start", "loss_length")
    return columns.mapInArrow(
        write, f"conv_id {kind}, example bigint, text string, loss_start bigint, loss_length bigint"
    )
