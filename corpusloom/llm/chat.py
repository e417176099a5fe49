"""Chat formatting by quotation linking.

A message is read as lines, each with its quote level: how many > stand before
it. What it says itself is at level 0. Quoted passages, single lines as well as
whole quoted blocks, are normalised and hashed, and so are the passages that
messages say themselves. A quotation belongs to the first message of the
conversation that says the passage. A message answers the earlier one to which
most of its quotations lead, the outermost level first; answers make threads, which
are ordered by turn, so that each message follows what it replies to.

Only DataFrame functions are used. Originals are one row for each passage and
conversation before anything is joined, so a phrase that everybody repeats
doesn't multiply, and threads are found by doubling pointers, each step a join on
message keys. No conversation is ever gathered in one task.

Defined cases: a null text counts as empty; null conversations and turns are
values of their own; messages equal in conversation, turn, role and text count as one;
a message never answers a later one or itself; messages without links start
threads of their own, whatever their turns; a thread longer than a part goes on in
further parts by rank; an empty table gives an empty result; extra columns stay
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE_CLASS, cut, let

_QUOTE = rf"^(?:[{SPACE_CLASS}]*>)+"
_BLANK = f"^[{SPACE_CLASS}]*$"


def _normal(text: Column) -> Column:
    """Case, punctuation at the ends and white space don't matter."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"[{SPACE_CLASS}]+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def parsed_lines(text: Column) -> Column:
    """Array of structs: level and body of each line."""

    def one(line: Column) -> Column:
        marks = F.regexp_extract(line, _QUOTE, 0)
        level = F.char_length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(level.alias("level"), F.when(level > 0, F.regexp_replace(F.substr(line, F.char_length(marks) + 1), r"^\x20", "")).otherwise(line).alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), one)


def runs(lines: Column) -> Column:
    """Lines of one level that stand together, blank ones between them aside, as one passage each."""

    def of(solid: Column) -> Column:
        level = lambda i: F.get(solid, i)["level"]
        starts = F.filter(F.sequence(F.lit(0), F.size(solid) - 1), lambda i: (i == 0) | (level(i) != level(i - 1)))
        return F.when(F.size(solid) > 0, let(starts, lambda at: F.transform(at, lambda i, k: joined(solid, i, F.coalesce(F.get(at, k + 1), F.size(solid))))))

    def joined(solid: Column, start: Column, end: Column) -> Column:
        body = F.array_join(F.transform(F.slice(solid, start + 1, end - start), lambda x: x["body"]), "\n")
        return F.struct(F.get(solid, start)["level"].alias("level"), body.alias("body"))

    found = let(F.filter(lines, lambda x: ~x["body"].rlike(_BLANK)), of)
    return F.coalesce(found, F.array().cast("array<struct<level:int,body:string>>"))


def own_text(lines: Column) -> Column:
    """What a message says itself: its lines at level 0, without blank ones at either end."""
    body = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.regexp_replace(body, rf"^(?:[\x20\x09\x0B-\x0D]*\n)+|(?:\n[\x20\x09\x0B-\x0D]*)+$", "")


def _passages(lines: Column) -> Column:
    """Level, hash and kind of every line and every run."""
    of = lambda xs: F.transform(xs, lambda x: F.struct(x["level"].alias("level"), _normal(x["body"]).alias("p")))
    whole = F.filter(F.array(F.struct(F.lit(0).alias("level"), _normal(own_text(lines)).alias("p"))), lambda x: x["p"] != "")
    every = F.filter(F.array_distinct(F.concat(of(lines), of(runs(lines)), whole)), lambda x: x["p"] != "")
    return F.transform(every, lambda x: F.struct(x["level"].alias("level"), F.xxhash64(x["p"]).alias("h1"), F.xxhash64(F.lit(5), x["p"]).alias("h2"), F.char_length(x["p"]).alias("len")))


def messages(talk: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Distinct messages: conv, turn, role, text, key (a hash of all four), lines, own."""
    base = talk.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    key = F.concat_ws("-", *[F.hex(F.xxhash64(F.lit(seed), "conv", "turn", "role", "text", F.col("conv").isNull(), F.col("turn").isNull(), F.col("role").isNull())) for seed in (1, 2)])
    return base.withColumn("key", key).withColumn("lines", parsed_lines(F.col("text"))).withColumn("own", own_text(F.col("lines")))


def reply_links(said: DataFrame) -> DataFrame:
    """key, parent (its key), at (its turn), n_linked: of every message that answers an earlier one."""
    passages = said.select("conv", "turn", "key", F.explode(let(F.col("lines"), _passages)).alias("x")).select("conv", "turn", "key", "x.level", "x.h1", "x.h2", "x.len")
    originals = passages.filter("level = 0").groupBy("conv", "h1", "h2").agg(F.min(F.struct("turn", "key")).alias("first"))
    quotes = passages.filter("level > 0")
    same = [quotes[c].eqNullSafe(originals[c]) for c in ("conv", "h1", "h2")]
    linked = quotes.join(originals, same[0] & same[1] & same[2]).filter(F.col("first.turn") < quotes["turn"]).select("key", "level", "len", F.col("first.key").alias("parent"), F.col("first.turn").alias("at"))
    votes = linked.groupBy("key", "level", "parent", "at").agg(F.sum("len").alias("weight"), F.count("*").alias("n"))
    best = F.struct((-F.col("level")).alias("level"), "weight", "at", "parent")
    return votes.groupBy("key").agg(F.max(best).alias("best"), F.sum("n").alias("n_linked")).select("key", F.col("best.parent").alias("parent"), F.col("best.at").alias("at"), "n_linked")


def threads(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """key, root (its thread's first message), thread (that one's turn), depth, by doubling pointers until none moves."""
    first = nodes.select("key", "turn").join(links.select("key", "parent", "at"), "key", "left")
    at = cut(first.select("key", F.coalesce("parent", "key").alias("root"), F.when(F.col("parent").isNull(), F.col("turn")).otherwise(F.col("at")).alias("thread"), F.col("parent").isNotNull().cast("int").alias("depth")), "threads")
    while True:
        up = at.filter("depth > 0").select(F.col("key").alias("root"), F.col("root").alias("above"), F.col("thread").alias("start"), F.col("depth").alias("more"))
        if at.join(up, "root", "left_semi").isEmpty():
            return at
        moved = F.col("above").isNotNull()
        step = at.join(up, "root", "left").select("key", F.coalesce("above", "root").alias("root"), F.when(moved, F.col("start")).otherwise(F.col("thread")).alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        at = cut(step, "threads")


def format_turn(role: Column, text: Column) -> Column:
    """One message as training text, with the role's name in front."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def link_messages(talk: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each distinct message.

    Columns: conversation, turn, role, reply_to (turn of the message it
    answers, null if none), thread (turn of the thread's first message), depth,
    n_quoted (quoted lines), n_linked (quoted passages with an original), text (without
    quotations), chat (the same, formatted), root (the key of the thread's first message) and
    message (its own key). A conversation reads by thread, then turn.
    """
    said = cut(messages(talk, conversation, turn, role, text), "messages")
    links = cut(reply_links(said), "replies")
    out = said.join(links, "key", "left").join(threads(said, links), "key")
    n_quoted = F.size(F.filter("lines", lambda x: (x["level"] > 0) & ~x["body"].rlike(_BLANK))).cast("long")
    return out.select(
        F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("role").alias(role), F.col("at").alias("reply_to"), "thread", F.col("depth").cast("long").alias("depth"), n_quoted.alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("own").alias(text), format_turn(F.col("role"), F.col("own")).alias("chat"), "root", F.col("key").alias("message"),
    )


def ranked(linked: DataFrame, turn: str = "turn") -> DataFrame:
    """``linked`` with place: how many messages of its thread come before each, by turn, then key.

    Messages are put in order over all partitions, so that a thread of any length is ranked by as many tasks as it fills.
    """
    row = cut(linked.repartitionByRange("root", turn, "message").sortWithinPartitions("root", turn, "message").withColumn("_row", F.monotonically_increasing_id()), "ranked")
    slot = F.shiftright("_row", 33).alias("_slot")
    runs = row.groupBy("root", slot).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("root").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that the thread fills
    offsets = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    placed = row.withColumn("_slot", slot).join(offsets, ["root", "_slot"])
    return placed.withColumn("place", F.col("_before") + F.col("_row") - F.col("_first")).drop("_row", "_slot", "_first", "_n", "_before")


def in_order(linked: DataFrame, conversation: str = "conv_id", turn: str = "turn", block: int = 1000) -> DataFrame:
    """Whole threads in reply order: conversation, thread, root, part and messages, an array of structs of place, turn, chat and the other columns.

    A thread of more than ``block`` messages is given in parts, numbered from 0, so that no row grows with it.
    """
    placed = ranked(linked, turn)
    inside = ["place", turn, "chat", *[c for c in linked.columns if c not in (conversation, turn, "thread", "chat", "root")]]
    inner = [F.pmod("place", F.lit(block)).alias("place"), *inside[1:]]
    return placed.withColumn("part", F.floor(F.col("place") / block)).groupBy(conversation, "thread", "root", "part").agg(F.array_sort(F.collect_list(F.struct(*inner))).alias("messages"))


def conversations(linked: DataFrame, conversation: str = "conv_id", turn: str = "turn", block: int = 1000) -> DataFrame:
    """Whole threads as arrays of formatted messages, in reply order and in parts as by ``in_order``."""
    return in_order(linked, conversation, turn, block).withColumn("messages", F.transform("messages", lambda x: x["chat"]))
