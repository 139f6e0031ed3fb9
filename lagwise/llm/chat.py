"""Chat logs: events folded into final messages, and messages rendered with a loss mask."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lagwise.llm.scratch import Scratch

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: What events do to their message; any other kind does nothing.
KINDS = ("open", "delta", "edit", "regenerate", "delete")
#: Code points of text after which a batch goes out.
FLUSH = 4 << 20
_ADD, _TAKE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No <| is left: every <\\...\\| gets one backslash more."""
    return _ADD.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _TAKE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(messages: list[tuple[str, str]], trained: frozenset[str] = frozenset({"assistant"})) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (start, end in code points) that count in the loss."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages that render() had."""
    out = []
    for part in formatted.split(BEGIN)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape_role(role), unescape(rest[: rest.rindex(END)])))
    return out


class Messages:
    """What the events of a run of a conversation's log do to its messages, in their order.

    kept: by message (turn, sub) its role (null: as before), whether its text begins anew, the
    pieces of text since, and whether it is deleted (null: as before). cut: the lowest turn after
    which the run has discarded what was there. So runs of a log can be folded apart and joined.
    """

    def __init__(self) -> None:
        self.kept: dict[tuple, list] = {}
        self.cut: tuple | None = None

    def apply(self, turn: int | None, sub: int | None, kind: str | None, role: str | None, text: str | None) -> None:
        if kind not in KINDS:
            return
        own = self.kept.setdefault((turn, sub), [None, False, [], None])
        if role is not None:
            own[0] = role
        if kind == "delta":
            own[2].append(text or "")
        elif kind == "delete":
            own[3] = True
        else:
            own[1], own[2] = True, [] if kind == "regenerate" else [text or ""]
            if kind == "open":
                own[3] = False
            else:
                at = _place(turn)
                self.cut = at if self.cut is None else min(self.cut, at)
                for other in [k for k in self.kept if _place(k[0]) > at]:
                    del self.kept[other]


def _place(turn: int | None) -> tuple:
    return (turn is not None, turn or 0)


MESSAGE_DDL = "conv_id long, turn long, sub long, role string, text string"
_RUN = pa.schema([("conv_id", pa.int64()), ("edge", pa.bool_()), ("seq0", pa.int64()), ("step0", pa.int32()), ("cut", pa.struct([("some", pa.bool_()), ("turn", pa.int64())])), ("turn", pa.int64()), ("sub", pa.int64()), ("role", pa.string()), ("anew", pa.bool_()), ("gone", pa.bool_()), ("text", pa.string())])
_RUN_DDL = "conv_id long, edge boolean, seq0 long, step0 int, cut struct<some:boolean,turn:long>, turn long, sub long, role string, anew boolean, gone boolean, text string"


def reconstruct(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, step, turn, sub, kind, role, text) -> final messages (conv_id, turn, sub, role, text).

    A message is (turn, sub) of a conversation, whose events apply by seq, then step: open begins a
    message, delta appends, edit replaces its text and regenerate empties it for the deltas that
    follow, and both discard all messages of later turns; delete removes the message alone, until it
    is opened again. An event's role, where it has one, becomes the message's. A delta to a message
    that isn't there begins it.

    The log is dealt out by ranges of conversation and sequence, so a hot conversation is cut into
    runs of its sequence. A task folds its runs; only conversations at a range's ends can go on
    elsewhere, and their runs are joined: a run loses the messages that a later one discards, and a
    message's texts are put together from the last run that begins it.

    Nulls: null keys are keys, a null turn comes before all others; a null kind does nothing, a null
    text is empty, a null seq comes first. Equal seqs and steps apply by turn, sub, kind, role and
    text; repeated rows apply repeatedly. Empty log: no rows. Very long texts stay whole. Other
    columns are ignored.
    """
    order = ("conv_id", "seq", "step")
    rows = events.select(*(F.col(c).cast("long") for c in ("conv_id", "seq", "turn", "sub")), F.col("step").cast("int"), "kind", "role", "text")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "turn", "sub", "kind", "role", "text")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, own, first, done, held, runs = None, None, Messages(), True, [], 0, 0

        def close(last: bool) -> None:
            nonlocal held, runs
            edge, cut = last or not runs, None if own.cut is None else dict(zip(("some", "turn"), own.cut, strict=True))
            runs += 1
            if edge:  # the run itself, whatever is left of it
                done.append((now, True, *begun, cut, None, None, None, None, None, None))
            for (turn, sub), (role, anew, pieces, gone) in own.kept.items():
                if edge or not gone:
                    done.append((now, edge, *begun, None, turn, sub, role, anew, gone, "".join(pieces)))
                    held += len(done[-1][-1])

        for batch in batches:
            for c, seq, step, *event in zip(*(batch.column(k).to_pylist() for k in (*order, "turn", "sub", "kind", "role", "text")), strict=True):
                if first or c != now:
                    if not first:
                        close(False)
                        if held >= FLUSH:
                            yield _rows(done, _RUN)
                            done, held = [], 0
                    now, begun, own, first = c, (seq, step), Messages(), False
                own.apply(*event)
        if not first:
            close(True)
        yield _rows(done, _RUN)

    runs = Scratch(events.sparkSession, "chat").save(dealt.mapInArrow(fold, _RUN_DDL), "runs")
    whole = runs.filter("not edge").select("conv_id", "turn", "sub", F.coalesce("role", F.lit("")).alias("role"), "text")
    # One row for each range that a conversation has an end in, at most one a task.
    ends = runs.filter("edge and text is null")
    later = W.partitionBy("conv_id").orderBy("seq0", "step0").rowsBetween(1, W.unboundedFollowing)
    ends = ends.select(F.col("conv_id").alias("e_conv"), F.col("seq0").alias("e_seq"), F.col("step0").alias("e_step"), F.min("cut").over(later).alias("later")).filter("later is not null")
    parts = runs.filter("edge and text is not null")
    on = F.col("conv_id").eqNullSafe(F.col("e_conv")) & F.col("seq0").eqNullSafe(F.col("e_seq")) & F.col("step0").eqNullSafe(F.col("e_step"))
    place = F.struct(F.col("turn").isNotNull().alias("some"), F.coalesce("turn", F.lit(0)).alias("turn"))
    parts = parts.join(ends, on, "left").filter(F.col("later").isNull() | (place <= F.col("later")))
    parts = parts.groupBy("conv_id", "turn", "sub").agg(F.array_sort(F.collect_list(F.struct("seq0", "step0", "role", "anew", "gone", "text"))).alias("runs"))
    joined = F.aggregate(
        "runs",
        F.struct(F.lit("").alias("role"), F.lit(False).alias("gone"), F.lit("").alias("text")),
        lambda a, x: F.struct(F.coalesce(x["role"], a["role"]).alias("role"), F.coalesce(x["gone"], a["gone"]).alias("gone"), F.when(x["anew"], x["text"]).otherwise(F.concat(a["text"], x["text"])).alias("text")),
    )
    parts = parts.withColumn("m", joined).filter("not m.gone").select("conv_id", "turn", "sub", "m.role", "m.text")
    return whole.unionByName(parts)


def _rows(done: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*done, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


FORMATTED_DDL = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def format_conversations(messages: DataFrame, trained: tuple[str, ...] = ("assistant",), order: tuple[str, ...] = ("turn", "sub", "role", "text")) -> DataFrame:
    """Messages -> one row a conversation: conv_id, n_turns, formatted, loss_spans.

    Messages come in the order of the columns `order`, nulls first; the loss covers the texts of the
    trained roles, without marks. Control strings inside texts and roles are escaped, reversibly.
    Null role or text: empty; a null conversation is one. Repeated rows are messages of their own.
    Other columns are ignored, whatever their names; no rows give none. A task streams through its
    conversations and holds one, which is its output row.
    """
    dealt = messages.select("conv_id", "turn", "sub", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", *order)
    roles = frozenset(trained)

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, done, held, begun = None, [], [], 0, False

        def close() -> None:
            nonlocal held
            text, spans = render(own, roles)
            done.append((now, len(own), text, [{"start": a, "end": b} for a, b in spans]))
            held += len(text)

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if begun and c != now:
                    close()
                    own = []
                    if held >= FLUSH:
                        yield _rows(done, _FORMATTED)
                        done, held = [], 0
                now, begun = c, True
                own.append((role or "", text or ""))
        if begun:
            close()
        yield _rows(done, _FORMATTED)

    return dealt.mapInArrow(form, FORMATTED_DDL)


def table_to_events(rows: DataFrame) -> DataFrame:
    """A table of finished turns (conv_id, turn, role, text) as the log that would have led to it.

    System turns are opened and edited, user turns opened and streamed in two deltas; for all others
    a wrong text is streamed and a turn after it opened, before a regeneration discards both and the
    text is streamed. Each row is a message of its own, also of rows that are equal; its sub is a
    number without an order. No shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    head, tail = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    role = F.coalesce("role", F.lit(""))
    none, after = F.lit(""), F.coalesce(F.try_add("turn", F.lit(1)), "turn", F.lit(0))

    def event(k: int, kind: str, body, turn=None):
        return F.struct(F.lit(k).alias("step"), (F.col("turn") if turn is None else turn).alias("turn"), F.lit(kind).alias("kind"), (role if kind == "open" else F.lit(None).cast("string")).alias("role"), body.alias("text"))

    system = F.array(event(0, "open", none), event(1, "delta", head), event(2, "edit", text))
    user = F.array(event(0, "open", none), event(1, "delta", head), event(2, "delta", tail))
    other = F.array(event(0, "open", none), event(1, "delta", F.lit("...")), event(2, "open", F.lit("?"), after), event(3, "regenerate", none), event(4, "delta", head), event(5, "delta", tail))
    log = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("sub", F.monotonically_increasing_id())
    log = log.select("conv_id", F.col("turn").alias("seq"), "sub", F.explode(F.when(role == "system", system).when(role == "user", user).otherwise(other)).alias("e"))
    return log.select("conv_id", "seq", "sub", "e.*")
