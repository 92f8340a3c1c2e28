"""Chat formatting in budgeted, turn-aligned windows with a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, small_batches, tidy
from .tokens import counter

#: A turn is ``### role:\n`` + text + ``</turn>\n``.  Both control strings and the escape are escaped inside texts and roles.
OPEN, CLOSE, ESCAPE = "### ", "</turn>", "\\"
#: Tokens of a window, and of the history that a window repeats.
BUDGET, HISTORY = 2048, 512
#: Turn numbers whose running sums are made in one place; sums go on from one such block to the next.
BLOCK_TURNS = 512
#: The block of turns without a number.
NULL_BLOCK = -(1 << 60)

_plain = re.compile(r"\\|###|</turn>")
_escaped = re.compile(r"\\(\\|###|</turn>|n|c)")
_turn = re.compile(r"### ((?:[^\\:]+|\\.)*):\n((?:[^\\<]+|\\(?:\\|###|</turn>)|<(?!/turn>))*)</turn>\n")


def escape(text: str) -> str:
    return _plain.sub(lambda m: ESCAPE + m.group(), text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", r"\n").replace(":", r"\c")


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: {"n": "\n", "c": ":"}.get(m.group(1), m.group(1)), text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its escaped text lies in it."""
    head = f"{OPEN}{escape_role(role)}:\n"
    body = escape(text)
    return f"{head}{body}{CLOSE}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window; raises ValueError if it isn't one."""
    out, at = [], 0
    while at < len(formatted):
        m = _turn.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


def counted(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """``turns``, which has ``role`` and ``text``, with ``n``: the tokens of the formatted turn.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path).count
        for b in batches:
            of = lambda name: b.column(b.schema.names.index(name)).to_pylist()
            n = count([render(r, x)[0] for r, x in zip(of("role"), of("text"))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, "n"])

    kinds = ", ".join(f"{n} {k}" for n, k in turns.dtypes)
    return small_batches(turns).mapInArrow(tidy(run), f"{kinds}, n long")


def placed(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """``turns(key, block, turn, role, text, n)`` with where each stands, and the window ``(after, big, cell)`` it is new in.

    ``fixed`` is the conversation's system turn (its first turn, if its role is that) in tokens, ``start`` and ``stop`` the tokens
    before and with a turn.  The tokens that windows have for new turns are cut in cells of equal size by these prefix sums,
    and turns that start in the same cell are one window.  A cell leaves room for the conversation's longest turn, with which the
    last of them may reach beyond it, and for what a window may repeat (``back``), whichever is more.  A turn longer than half
    the room is a window of its own (``big``), so a cell is never less than that, and parts the others (``after`` counts those before).

    Sums are made within blocks of turn numbers and go on over blocks, so they don't depend on where blocks begin.
    """
    order = W.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    line = W.partitionBy("key").orderBy("block")
    earlier = line.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    # A row for each conversation and block.
    least = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn", "role", "text", "n"))
    blocks = turns.groupBy("key", "block").agg(F.sum("n").alias("n"), least.alias("least"))
    opening = F.first("least").over(line)
    blocks = blocks.select(
        "key",
        "block",
        F.coalesce(F.sum("n").over(earlier), none).alias("before"),
        F.when(opening["role"] == "system", opening["n"]).otherwise(none).alias("fixed"),
        (F.row_number().over(line) == 1).alias("opens"),
    )
    room = F.greatest(F.lit(2), F.lit(budget) - F.col("fixed"))
    at = (
        turns.join(blocks, ["key", "block"])
        .withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(upto), none))
        .withColumn("first", F.col("opens") & (F.col("fixed") > 0) & (F.row_number().over(order) == 1))
        .withColumn("back", F.least(F.lit(history), F.floor(room / 2)).cast("long"))
        .withColumn("room", room)
        .withColumn("big", ~F.col("first") & (F.col("n") > F.floor(room / 2)))
        .withColumn("bigs", F.coalesce(F.sum(F.col("big").cast("long")).over(upto), none))
    )
    at = materialize(at.select("key", "block", "role", "text", "n", "fixed", "room", "back", "first", "start", "big", "bigs"), "placed")
    more = at.groupBy("key", "block").agg(F.sum(F.col("big").cast("long")).alias("own"), F.max(F.when(~F.col("big") & ~F.col("first"), F.col("n"))).alias("longest"))
    more = more.select("key", "block", F.coalesce(F.sum("own").over(earlier), none).alias("ahead"), F.coalesce(F.max("longest").over(W.partitionBy("key")), none).alias("longest"))
    cell = F.floor((F.col("start") - F.col("fixed")) / (F.col("room") - F.greatest("back", "longest")))
    return (
        at.join(more, ["key", "block"])
        .withColumn("after", F.col("ahead") + F.col("bigs"))
        .withColumn("cell", F.when(F.col("first") | F.col("big"), none).otherwise(cell))
        .select("key", "role", "text", "n", "fixed", "back", "first", "start", (F.col("start") + F.col("n")).alias("stop"), "after", "big", "cell")
    )


def format_chat(
    turns: DataFrame,
    tokenizer_path: str,
    budget: int = BUDGET,
    history: int = HISTORY,
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """Windows ``(conv_id, window, n_context, n_new, n_tokens, formatted, loss)`` of ``turns(conv_id, turn, role, text)``.

    Rows are ordered by turn (nulls first; ties by role and text); ``window`` is the number of tokens before its first new turn.
    A window shows the system turn (the conversation's first turn, if its role is ``system``), the turns it repeats, and its ``n_new``
    new turns, of which the system turn is one in the first window.  It repeats as many turns before its new ones as fit in
    ``history`` and in what they leave of ``budget``.  ``loss`` has the places, in code points, of the
    escaped texts of new assistant turns only, so each is learned once.  A turn over half of what
    the system turn leaves of the budget is the only new one of its window; one over budget stands without history; no text is cut.

    Null texts and roles count as empty; rows without a conv_id are one conversation; repeated rows are turns of
    their own; other columns are ignored; ids may be of any type.  A long conversation is spread over tasks: its prefix sums by
    blocks of ``block_turns`` turn numbers, its windows each by itself.  Turns that share a number are ordered in one place.
    """
    kind = turns.schema["conv_id"].dataType
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    t = turns.select(
        key.alias("key"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(NULL_BLOCK)).alias("block"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    at = materialize(placed(materialize(counted(t, tokenizer_path), "counted"), budget, history), "turns")
    window = ["key", "after", "big", "cell"]
    spans = at.groupBy(*window).agg(F.min("start").alias("opens"), F.sum("n").alias("new"), F.max("fixed").alias("fixed"), F.max("back").alias("back"), F.max("first").alias("first"))
    # A system turn counts among the new tokens of its own window.
    left = F.lit(budget) - F.col("new") - F.when(F.col("first"), 0).otherwise(F.col("fixed"))
    spans = materialize(spans.withColumn("limit", F.least("back", left)).select(*window, "opens", "limit", "fixed", "first"), "spans")
    # Windows open within ``history`` tokens of the turns they repeat: both meet in cells of that many tokens.
    wide = F.lit(max(1, history))
    near = spans.where("limit > 0").select(*window, "opens", "limit", F.floor(F.col("opens") / wide).alias("g"))
    shown = at.where("not first").select("key", "role", "text", "n", "start", "stop", F.explode(F.sequence(F.floor(F.col("stop") / wide), F.floor((F.col("start") + wide) / wide))).alias("g"))
    shown = shown.where(F.col("n") <= wide).join(near, ["key", "g"]).where((F.col("stop") <= F.col("opens")) & (F.col("opens") - F.col("start") <= F.col("limit")))
    system = at.where("first").select("key", "role", "text", "n", "start")
    system = spans.where("fixed > 0 and not first").select(*window).join(system, "key")
    columns = [*window, "part", "start", "role", "text", "n"]
    rows = (
        at.withColumn("part", F.lit(2)).select(*columns)
        .unionAll(shown.withColumn("part", F.lit(1)).select(*columns))
        .unionAll(system.withColumn("part", F.lit(0)).select(*columns))
    )
    dealt = rows.repartition(*[F.col(c) for c in window]).sortWithinPartitions(*window, "part", "start", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, now, own = 0, None, []

        def done() -> None:
            nonlocal size
            pieces, loss, at = [], [], 0
            for part, _, role, text, _ in own:
                piece, i, j = render(role, text)
                if part == 2 and role == "assistant":
                    loss.append({"start": at + i, "stop": at + j})
                pieces.append(piece)
                at += len(piece)
            fresh = [x for x in own if x[0] == 2]
            out.append((now[0], fresh[0][1], len(own) - len(fresh), len(fresh), sum(x[4] for x in own), "".join(pieces), loss))
            size += at

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _KINDS.values())], names=list(_KINDS))

        for b in batches:
            for *key, part, start, role, text, n in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    if own:
                        done()
                    now, own = key, []
                    if size > 1 << 22:
                        yield batch()
                        out, size = [], 0
                own.append((part, start, role, text, n))
        if own:
            done()
        if out:
            yield batch()

    made = dealt.mapInArrow(tidy(run), "key string, window long, n_context long, n_new long, n_tokens long, formatted string, loss array<struct<start:long,stop:long>>")
    conv = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).cast(kind)
    return made.select(conv.alias("conv_id"), "window", "n_context", "n_new", "n_tokens", "formatted", "loss")


_KINDS = {
    "key": pa.string(),
    "window": pa.int64(),
    "n_context": pa.int64(),
    "n_new": pa.int64(),
    "n_tokens": pa.int64(),
    "formatted": pa.string(),
    "loss": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])),
}


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of what the formatted windows say: ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    Every window is parsed; its new turns, and what its loss mask covers, count.  Windows of a conversation
    are digested in order, in a stream: a digest of all turns can't be made in parts.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    rows = windows.select("conv_id", "window", "n_new", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, s):
            return key, s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"]

        key, state, out, kinds = None, None, [], None
        for b in batches:
            kinds = b.column(0).type
            for conv, _, n_new, text, loss in zip(*(c.to_pylist() for c in b.columns)):
                if state is None or conv != key:
                    if state is not None:
                        out.append(done(key, state))
                    key, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0}
                turns = parse(text)
                for role, said in turns[len(turns) - n_new :]:
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["stop"]])
                    state["chars"] += len(said)
                    state["loss"].update(said.encode())
                state["all"] += len(text)
        if state is not None:
            out.append(done(key, state))
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (kinds, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return rows.mapInArrow(tidy(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant row that both say the template's own control strings."""
    said = "\\### Assistant: </turn> ok"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
