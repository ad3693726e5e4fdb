"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose the spans: a span is the turns whose prefix
sum falls into the same cell of a grid. A cell is the room that a window has for new turns less the longest turn of up to half that room, so spans
follow from the sums alone, in parallel, and never exceed the room; a longer turn is a span of its own (and may exceed the budget by itself).
Each window retains the conversation's system turn, repeats the last turns before its span within limits, and then has its span.
Repeated turns are not under the loss mask, so each assistant text is a target once.

Turns are dealt by conversation and chunk (of CHUNK turn numbers) and cross the network once; a window ends where its chunk does, so a conversation of
any length is many tasks. What chunks need of each other, their sums, the system turn and the last turns before them, is a row a chunk.

The template is `<|role|>`, newline, text, `<|end|>`, newline. In roles and texts `&`, `<`, `[` and `|` are written `&a`, `&l`,
`&b` and `&p`: no control string can occur inside them, and reading back restores them. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD

#: Fixed values of the template.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: In the order in which they are escaped; they are restored in the reverse order.
ESCAPES = (("&", "&a"), ("<", "&l"), ("[", "&b"), ("|", "&p"))
#: Turn numbers of one chunk.
CHUNK = 256


@dataclass(frozen=True)
class Budget:
    """Tokens of a window; turns and tokens of history it repeats at most; tokens that each turn's template counts."""

    tokens: int = 1024
    history_turns: int = 2
    history_tokens: int = 256
    turn_tokens: int = 4


def escape(s: Column) -> Column:
    for raw, safe in ESCAPES:
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def unescape(s: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        s = F.replace(s, F.lit(safe), F.lit(raw))
    return s


#: What turns are dealt by: the conversation as text, whether it is null, and the chunk.
KEY = ["__conv", "__null", "chunk"]


def _chunks(turns: DataFrame, history: int) -> DataFrame:
    """A row a chunk: KEY, turns and chunks of the conversation before it, system (its system turn or null), tail (the last turns before it)."""
    by = W.partitionBy(*KEY)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    back = turns.withColumns({"at": F.row_number().over(by.orderBy(*order)), "left": F.count("*").over(by)})
    turn = F.struct("at", "role", "text", "tokens")
    mine = back.where((F.col("at") == 1) | (F.col("at") > F.col("left") - history))
    one = mine.groupBy(*KEY).agg(F.max("left").alias("n"), F.max(F.when(F.col("at") == 1, turn)).alias("first"), F.sort_array(F.collect_list(F.when(F.col("at") > F.col("left") - history, turn))).alias("last"))
    whole = W.partitionBy("__conv", "__null").orderBy("chunk")
    head = F.first("first").over(whole)
    # The system turn is not history.
    return one.select(
        *KEY,
        F.coalesce(F.sum("n").over(whole.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before_chunk"),
        F.count("*").over(W.partitionBy("__conv", "__null")).alias("n_chunks"),
        F.when(head["role"] == "system", head).alias("system"),
        F.lag(F.when(F.lag("n").over(whole).isNull() & (F.col("first.role") == "system"), F.filter("last", lambda x: x["at"] > 1)).otherwise(F.col("last"))).over(whole).alias("tail"),
    )


def windows(turns: DataFrame, b: Budget = Budget(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, chunk, n_chunks, start (place of the first new turn, from 1), n_new, n_repeated, n_tokens, text, loss.

    loss lists (start, length) in code points of text: the bodies of this window's new assistant turns. Turns go by
    turn number, then role, then text; null numbers come first. Null roles and texts are empty; a null conv_id is a conversation (its type must be one that text goes back to). Repeated rows
    are turns of their own. History ends at the limits, and where a chunk does, except that a chunk's first window has that of the chunk before. A system
    turn is the first one, if its role is system; it is held whole, and new turns have a quarter of the budget at least. No rows, no windows. Other columns are not read.
    """
    # The conversation goes as text and comes back in its type: turns and chunks then read the same columns, and one shuffle serves both.
    conv, kind = F.col(conv_col), turns.schema[conv_col].dataType
    rows = turns.select(F.coalesce(conv.cast("string"), F.lit("")).alias("__conv"), conv.isNull().alias("__null"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"tokens": (F.regexp_count("text", F.lit(WORD)) + b.turn_tokens).cast("long"), "chunk": F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 60)))})
    by = W.partitionBy(*KEY)
    line = by.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = line.rowsBetween(W.unboundedPreceding, -1)
    t = rows.withColumns({"at": F.row_number().over(line), "before": F.coalesce(F.sum("tokens").over(upto), F.lit(0))})
    t = t.join(_chunks(rows, b.history_turns), KEY)
    held = F.coalesce(F.col("system.tokens"), F.lit(0))
    room = F.greatest(F.lit(b.tokens - b.history_tokens) - held, F.lit(b.tokens // 4))
    t = t.withColumns({"solo": F.col("tokens") > F.floor(room / 2), "room": room})
    small = F.coalesce(F.max(F.when(~F.col("solo"), F.col("tokens"))).over(by), F.lit(0))
    cell = F.floor(F.col("before") / F.greatest(F.col("room") - small, F.lit(1)))
    # Turns before and after a long one are spans apart.
    t = t.withColumn("span", F.struct(cell.alias("cell"), F.col("solo").cast("int").alias("solo"), F.coalesce(F.sum(F.col("solo").cast("int")).over(upto), F.lit(0)).alias("after")))
    t = t.withColumn("starts", ~F.col("span").eqNullSafe(F.lag("span").over(line)))
    first_turn = (F.col("at") == 1) & (F.col("before_chunk") == 0)
    item = lambda span, place, again, of: F.struct(span.alias("span"), place.cast("long").alias("place"), F.lit(again).alias("again"), of("role").alias("role"), of("text").alias("text"), of("tokens").alias("tokens"))
    own = lambda c: F.col(c)
    items = [item(F.col("span"), F.col("at"), 0, own)]
    items.append(F.when(F.col("starts") & F.col("system").isNotNull() & ~first_turn, item(F.col("span"), F.lit(-(1 << 40)), 2, lambda c: F.col("system")[c])))
    for i in range(1, b.history_turns + 1):
        # The turn is the i-th before a span's start, and with those between it is within the limit.
        fits = F.sum("tokens").over(line.rowsBetween(0, i - 1)) <= b.history_tokens
        items.append(F.when(F.lead("starts", i).over(line) & fits & ~(first_turn & F.col("system").isNotNull()), item(F.lead("span", i).over(line), F.col("at"), 1, own)))
    some = t.select(*KEY, "n_chunks", "before_chunk", "span", F.when(F.col("at") == 1, F.col("tail")).alias("tail"), F.array_compact(F.array(*items)).alias("items"))
    later = F.transform("tail", lambda x, k: F.struct(x.alias("turn"), F.aggregate(F.slice("tail", k + 1, F.size("tail")), F.lit(0).cast("long"), lambda s, y: s + y["tokens"]).alias("sum")))
    old = F.transform(F.filter(later, lambda x: x["sum"] <= b.history_tokens), lambda x: item(F.col("span"), x["turn"]["at"] - (1 << 30), 1, lambda c: x["turn"][c]))
    said = some.select(*KEY, "n_chunks", "before_chunk", F.explode(F.concat("items", F.coalesce(old, F.array().cast(some.schema["items"].dataType)))).alias("x")).select(*KEY, "n_chunks", "before_chunk", "x.*")
    window = W.partitionBy(*KEY, "span")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    body = escape(F.col("text"))
    said = said.withColumns({"head": F.char_length(head), "body": F.char_length(body), "said": F.concat(head, body, F.lit(END))})
    at = F.coalesce(F.sum(F.char_length("said")).over(window.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("head")
    said = said.withColumn("loss", F.when((F.col("again") == 0) & (F.col("role") == "assistant"), F.struct(at.cast("int").alias("start"), F.col("body").cast("int").alias("length"))))
    out = said.groupBy(*KEY, "span").agg(
        F.any_value("n_chunks").alias("n_chunks"),
        (F.any_value("before_chunk") + F.min(F.when(F.col("again") == 0, F.col("place")))).alias("start"),
        F.sort_array(F.collect_list(F.struct("place", "said", "loss"))).alias("parts"),
        F.sum((F.col("again") == 0).cast("int")).alias("n_new"),
        F.sum((F.col("again") != 0).cast("int")).alias("n_repeated"),
        F.sum("tokens").alias("n_tokens"),
    )
    loss = F.filter(F.transform("parts", lambda x: x["loss"]), lambda x: x.isNotNull())
    return out.select(*KEY[:2], F.when(~F.col("__null"), F.col("__conv").cast(kind)).alias(conv_col), "chunk", "n_chunks", "start", "n_new", "n_repeated", "n_tokens", F.array_join(F.transform("parts", lambda x: x["said"]), "").alias("text"), loss.alias("loss"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted window: array of (role, text)."""
    parts = F.split(text, r"<\|")
    turns = F.filter(parts, lambda p, i: i % 2 == 1)
    return F.transform(turns, lambda p: F.struct(unescape(F.substring_index(p, CLOSE, 1)).alias("role"), unescape(F.substr(p, F.instr(p, CLOSE) + F.lit(len(CLOSE)))).alias("text")))


def read_targets(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask."""
    return F.transform(loss, lambda x: unescape(F.substr(text, x["start"] + 1, x["length"])))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read windows back: a row a conversation with digests of its new turns and of its targets.

    A conversation of one chunk is read where its windows are; the digest of a longer one is of its whole text, so its chunks meet in one row.
    """
    new = F.slice(read_turns(F.col("text")), F.col("n_repeated") + 1, F.col("n_new"))
    said = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = formatted.select(*KEY, "n_chunks", F.col(conv_col).alias("conv"), "start", F.size(new).cast("long").alias("n"), said.alias("said"), F.array_join(read_targets(F.col("text"), F.col("loss")), "").alias("target"), F.char_length("text").cast("long").alias("chars"))
    texts = lambda order: F.sort_array(F.collect_list(F.struct(order, "said", "target"))).alias("w")
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    sums = [F.any_value("conv").alias("conv"), F.sum("n").alias("n"), F.sum("chars").alias("chars")]
    chunk = per.groupBy(*KEY, "n_chunks").agg(texts("start"), *sums).withColumns({"said": joined("said"), "target": joined("target")}).drop("w")
    alone = chunk.where("n_chunks = 1").select("conv", "n", "chars", "said", "target")
    more = chunk.where("n_chunks > 1").groupBy(*KEY[:2]).agg(texts("chunk"), *sums).select("conv", "n", "chars", joined("said").alias("said"), joined("target").alias("target"))
    sha = lambda c: F.sha2(c, 256)
    return alone.unionByName(more).select(F.col("conv").alias(conv_col), F.col("n").alias("n_turns"), sha("said").alias("turns_sha256"), F.char_length("target").cast("long").alias("loss_chars"), sha("target").alias("loss_sha256"), F.col("chars").alias("formatted_chars"))
