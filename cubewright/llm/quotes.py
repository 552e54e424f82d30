"""Reply-ordered conversations by quotation linking, in DataFrame code only.

A message's lines are parsed into passages: runs of lines of one quote level
(the number of leading ``>`` marks), cut at empty lines. A passage is normalised
(lower case, white space collapsed) and hashed by SHA-256, so that re-wrapped
quotations match and equal hashes are equal words. Each quoted passage is joined
to the earliest message of its own conversation that has the same passage as its
own words, however short; only where its conversation has none, and the passage
has at least ``min_chars`` characters (0: any), to the earliest message of all.
The message replies to the original of its shallowest linked quotation, the
latest if several are linked at that level. Only earlier messages (by
conversation and turn) count, so replies form a forest; roots and depths come
from pointer jumping, each round written to the shared folder.

The index holds one original per passage and conversation, and one per passage,
so a passage that very many messages share makes one row of each, and joins
never multiply. Rows of one thread stand together in ``reply_order``, a replied
message before its replies; the numbers come from one range sort, spread over
tasks however large a thread is.

Edge cases: null text counts as empty; messages that quote nothing known begin a
thread with depth 0 (turn order within a conversation stays); an attribution line
("On ... wrote:", of any length) before a quotation goes with it and is part of
no passage; messages with null conv_id or turn are kept as they are and link to
nothing; rows that repeat conv_id and turn are each linked by their own text, and
the first of them in the order of their texts' digests is the original of words
that several have; entire rows that repeat share a link; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, stored

#: Passages of fewer characters ("yes", "thanks") link within their conversation only.
MIN_CHARS = 20
_ATTRIBUTION = r"(?i)^\s*(on|am|le|el)\b.*\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
_LINE = "array<struct<level:int,body:string>>"


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, r"^[\s>]*", 0), r"[^>]", ""))


def lines_of(text: Column) -> Column:
    """array<struct<level, body>> of a message's lines; attribution lines become empty ones."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    parsed = F.transform(lines, lambda x: F.struct(F.when(x.rlike(r"^\s*>"), _level(x)).otherwise(0).alias("level"), F.when(x.rlike(r"^\s*>"), F.regexp_replace(x, r"^[\s>]+", "")).otherwise(x).alias("body")))
    return _once(parsed, lambda all_: F.transform(all_, lambda x, i: F.when((x["level"] == 0) & x["body"].rlike(_ATTRIBUTION) & (F.coalesce(F.get(all_, i + 1)["level"], F.lit(0)) > 0), F.struct(F.lit(0).alias("level"), F.lit("").alias("body"))).otherwise(x))).cast(_LINE)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` where ``value`` is worked out once per row, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _runs(lines: Column) -> Column:
    """Passages (level, body): runs of lines of one level, no empty line inside."""
    empty = lambda x: F.trim(x["body"]) == ""
    begins = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: (i == 0) | (F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]) | empty(F.get(lines, i)) | empty(F.get(lines, i - 1)),
    )

    def cut(at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(lines))
        body = lambda k: F.array_join(F.transform(F.slice(lines, F.get(at, k) + 1, end(k) - F.get(at, k)), lambda x: x["body"]), "\n")
        return F.transform(F.sequence(F.lit(0), F.size(at) - 1), lambda k: F.struct(F.get(lines, F.get(at, k))["level"].alias("level"), body(k).alias("body")))

    return _once(begins, cut)


def _hash(body: Column) -> Column:
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.lower(body), r"\s+", " ")).cast("binary"), 256))


def parsed(messages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """conv_id, turn, role, digest (of the text), own (text without quotes), passages (level, hash, long)."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), digest.alias("digest"), lines_of(F.col("text")).alias("lines"))
    said = lambda lines: F.filter(_runs(lines), lambda p: F.trim(p["body"]) != "")
    hashed = _once(F.col("lines"), lambda lines: F.transform(said(lines), lambda p: F.struct(p["level"].alias("level"), _hash(p["body"]).alias("hash"), (F.length(F.trim(p["body"])) >= min_chars).alias("long"))))
    own = F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["body"])
    return rows.select("conv_id", "turn", "role", "digest", F.regexp_replace(F.array_join(own, "\n"), r"^\s+|\s+$", "").alias("own"), hashed.alias("passages"))


#: What tells a message from others; links go from one such key to another.
KEY = ("conv_id", "turn", "digest")


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, to): what each message replies to, ``to`` a struct of the same key."""
    at = F.struct(*KEY)
    each = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(*KEY, F.explode("passages").alias("p")).select(*KEY, "p.level", "p.hash", "p.long")
    quoted = stored(each.where("level > 0").groupBy(*KEY, "hash").agg(F.min("level").alias("level"), F.max("long").alias("long")), "quoted")
    near = stored(each.where("level = 0").groupBy("hash", "conv_id").agg(F.min(at).alias("near"), F.max("long").alias("long")), "near")
    far = stored(near.where("long").groupBy("hash").agg(F.min("near").alias("far")).withColumnRenamed("hash", "said"), "far")
    near = near.select(F.col("hash").alias("same"), F.col("conv_id").alias("conv"), "near")
    earlier = lambda x: F.struct(x["conv_id"], x["turn"]) < F.struct("conv_id", "turn")
    here = quoted.join(near, (F.col("hash") == F.col("same")) & (F.col("conv_id") == F.col("conv")) & earlier(F.col("near")), "left")
    found = here.join(far, (F.col("hash") == F.col("said")) & F.col("near").isNull() & F.col("long"), "left")
    found = found.withColumn("original", F.coalesce("near", "far")).where("original IS NOT NULL").where(earlier(F.col("original")))
    order = F.struct("level", (-F.col("original.conv_id")).alias("c"), (-F.col("original.turn")).alias("t"), F.col("original.digest").alias("d"))
    best = found.groupBy(*KEY).agg(F.min(order).alias("b"))
    return best.select(*KEY, F.struct((-F.col("b.c")).alias("conv_id"), (-F.col("b.t")).alias("turn"), F.col("b.d").alias("digest")).alias("to"))


def roots(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, to, root, depth) of each linked message."""
    out = stored(edges.select("*", F.col("to").alias("root"), F.lit(1).cast("long").alias("depth"), F.lit(True).alias("moved")), "replies")
    while not out.where("moved").isEmpty():
        up = out.select(F.struct(*KEY).alias("of"), F.col("root").alias("above"), F.col("depth").alias("more"))
        hop = out.join(up, F.col("root") == F.col("of"), "left")
        made = hop.select(*KEY, "to", F.coalesce("above", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("of").isNotNull().alias("moved"))
        out = stored(made, "replies", instead_of=out)
    return out.drop("moved")


def conversations(messages: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of ``messages``: conv_id, turn, role, text (without quotes),
    reply_to_conv, reply_to_turn, thread_conv, thread_turn, depth, reply_order.

    A thread is its first message and all that reply to it or to each other; its
    rows share (thread_conv, thread_turn), the first message's own. A message that
    links nowhere and has no replies is its conversation's: thread_turn is null.
    Sorted by reply_order, the rows of a thread or conversation stand together by
    depth, conv_id and turn, so that each reply follows what it replies to.
    """
    rows = stored(parsed(messages, min_chars), "messages")
    up = roots(links(rows))
    first = up.select("root").distinct().select(F.col("root").alias("self"))
    mine = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEY]
    keyed = up.withColumnsRenamed({k: f"__{k}" for k in KEY})
    joined = rows.join(keyed, mine, "left").drop(*[f"__{k}" for k in KEY])
    joined = joined.join(first, F.struct(*KEY) == F.col("self"), "left")
    out = joined.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.col("to.conv_id").alias("reply_to_conv"), F.col("to.turn").alias("reply_to_turn"),
        F.coalesce("root.conv_id", "conv_id").alias("thread_conv"), F.coalesce("root.turn", F.when(F.col("self").isNotNull(), F.col("turn"))).alias("thread_turn"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), "digest",
    )
    out = stored(out.withColumn("row", F.monotonically_increasing_id()), "threads")
    # The stored row number splits rows that are equal in all else.
    parts = int(out.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["thread_conv", "thread_turn", "depth", "conv_id", "turn", "digest", "row"]
    made = stored(out.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("digest", "row").withColumn("reply_order", F.monotonically_increasing_id()), "ordered")
    forget(out)
    return made
