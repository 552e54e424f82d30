"""Mixing sources to target weights by iterative proportional fitting.

Documents are pre-aggregated to cells of source, language and topic with their
tokens. Raking scales the cell weights to the target share of each source, each
language and each topic in turn, until every marginal is within ``TOLERANCE`` of
its target (told by one number every few rounds), or, where the targets contradict each
other, until that hardly changes; ``MAX_ROUNDS`` bounds both. A
document's inclusion probability is its cell's raked tokens over its actual
tokens, times the one factor that makes the largest probability 1; documents are
drawn by a hash of doc_id and text, so the sample is the same however the rows
are dealt out.

All of it is DataFrame code. At most ``MAX_CELLS`` cells (counted) are raked in
one task, some rounds a job. Beyond, a round sums the cells by each dimension and
joins the sums back, so that any number of cells is spread over tasks.

Edge cases: null text counts as empty; null source, lang and topic are values of
their own; documents without tokens get the probability of their cell, 1 in
cells without any tokens; rows are drawn each by doc_id and text, entire rows that
repeat together; a target for a value that no document has is left out, a value
without a target keeps its share; the stage replaces columns that have the names
of those it adds; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, stored, within

DIMENSIONS = ("source", "lang", "topic")
TOLERANCE = 1e-4
#: Rounds between two looks at the marginals, and rounds in all.
AT_ONCE = 5
MAX_ROUNDS = 100
TEMPER = 0.7
#: So many cells at most are raked in one task and broadcast to the rows (the result is the same beyond).
MAX_CELLS = 50_000
SEED = 17
ADDED = ("mix_probability", "mix_weight", "mix_tokens")


def tokens_of(text: Column) -> Column:
    """Words between white space; counted from lengths, without splitting."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "a")
    return F.length(F.regexp_replace(words, r"[\x20\x09-\x0D]+", "")).cast("long")


def topic_of(text: Column) -> Column:
    """The kind of text, where there is no topic column: a fixed rule on its whole text."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(text)
    signs = F.regexp_count(text, F.lit(r"[%&$#*{}\[\]<>=|\\~^_]"))
    digits = F.regexp_count(text, F.lit("[0-9]"))
    lines = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(signs * 20 > n, "symbols").when(digits * 50 > n, "figures").when(lines * 200 > n, "lines").when(n > 4000, "long prose").otherwise("prose")


def _given(by: str, targets: dict[str, float]) -> Column:
    """The given target of each row's value; null where none is given."""
    pairs = [x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))]
    return F.element_at(F.create_map(*pairs), F.coalesce(F.col(by), F.lit(""))) if pairs else F.lit(None).cast("double")


def _joined(left: DataFrame, right: DataFrame, by: tuple[str, ...], small: bool = False) -> DataFrame:
    """``left`` with the other columns of ``right``, which has one row for each value of ``by``; nulls equal each other."""
    tag = uuid.uuid4().hex
    renamed = right.withColumnsRenamed({d: f"__{tag}{d}" for d in by})
    same = [F.col(d).eqNullSafe(F.col(f"__{tag}{d}")) for d in by]
    return left.join(F.broadcast(renamed) if small else renamed, same, "left").drop(*[f"__{tag}{d}" for d in by])


def _targets(cells: DataFrame, by: str, given: dict[str, float] | None) -> DataFrame:
    """(by, target): the share that each value is to have; they sum to 1."""
    share = F.col("weight") if given else F.pow("weight", F.lit(TEMPER))
    if given:
        share = F.coalesce(_given(by, given), share)
    shares = cells.groupBy(by).agg(F.sum("weight").alias("weight")).select(by, share.alias("share"))
    return shares.crossJoin(shares.agg(F.sum("share").alias("all"))).select(by, (F.col("share") / F.col("all")).alias("target"))


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight``: raked shares that sum to 1.

    Without targets a dimension's shares are those of its tokens to the power
    ``TEMPER``, scaled to sum to 1.
    """
    small = within(cells, MAX_CELLS)
    total = cells.agg(F.sum("tokens").alias("all"))
    out = cells.crossJoin(total).withColumn("weight", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0))).drop("all")
    out = stored(out.coalesce(1) if small else out, "cells")
    wanted = [stored(_targets(out, by, (targets or {}).get(by)), f"{by}-targets") for by in DIMENSIONS]
    made = out
    for by, target in zip(DIMENSIONS, wanted):
        made = _joined(made, target.withColumnRenamed("target", f"to_{by}"), (by,))
    out, before = stored(made.coalesce(1) if small else made, "cells", instead_of=out), None
    forget(*wanted)
    for _ in range(0, max_rounds, AT_ONCE):
        out = stored(_few(out), "cells", instead_of=out) if small else _many(out)
        off = max(_off(out, by) for by in DIMENSIONS[:-1])  # the last one has just been met
        if off <= tolerance or before is not None and abs(before - off) <= tolerance * off:
            break
        before = off
    return out.select(*DIMENSIONS, "tokens", "weight")


def _scaled(by: str, total: Column) -> Column:
    return F.when(total > 0, F.col("weight") * F.col(f"to_{by}") / total).otherwise(F.lit(0.0))


def _few(cells: DataFrame) -> DataFrame:
    """``AT_ONCE`` rounds over at most ``MAX_CELLS`` cells, in one task and one job."""
    cells = cells.coalesce(1)
    for _ in range(AT_ONCE):
        for by in DIMENSIONS:
            cells = cells.withColumn("weight", _scaled(by, F.sum("weight").over(Window.partitionBy(by))))
    return cells


def _many(cells: DataFrame) -> DataFrame:
    """The same rounds over any number of cells: sums with partial aggregation, joined back, each step stored."""
    for _ in range(AT_ONCE):
        for by in DIMENSIONS:
            sums = stored(cells.groupBy(by).agg(F.sum("weight").alias("sum")), "sums")
            made = _joined(cells, sums, (by,)).withColumn("weight", _scaled(by, F.col("sum"))).drop("sum")
            cells = stored(made, "cells", instead_of=cells)
            forget(sums)
    return cells


def _off(cells: DataFrame, by: str) -> float:
    """How far the worst marginal is from its target, as a part of it; values without tokens can't be met."""
    sums = cells.groupBy(by).agg(F.sum("weight").alias("sum"), F.max(f"to_{by}").alias("target")).where("target > 0 AND sum > 0")
    return sums.agg(F.max(F.abs(F.col("sum") / F.col("target") - 1))).first()[0] or 0.0


def _ratios(cells: DataFrame, targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """(source, lang, topic, probability) of each cell."""
    raked = rake(cells, targets).select(*DIMENSIONS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).alias("ratio"))
    most = raked.agg(F.max("ratio").alias("most"))
    return stored(raked.crossJoin(most).select(*DIMENSIONS, F.coalesce(F.col("ratio") / F.col("most"), F.lit(1.0)).alias("probability")), "raked")


def _cells(rows: DataFrame) -> DataFrame:
    return stored(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")), "cells")


def _dimension(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def draw(doc_id: Column, digest: Column) -> Column:
    """A number from 0 to 1 for each row, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(SEED), doc_id, digest), F.lit(1 << 40)) / float(1 << 40)


def probabilities(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, lang, topic, n_tokens,
    probability, weight (1 / probability), sampled."""
    kind = F.col(topic).cast("string") if topic else topic_of(F.col("text"))
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), _dimension("source"), _dimension("lang"), kind.alias("topic"), tokens_of(F.col("text")).alias("n_tokens"), draw(doc_id, F.xxhash64(text)).alias("draw"))
    rows = stored(rows, "tokens")
    cells = _cells(rows)
    joined = _joined(rows, _ratios(cells, targets), DIMENSIONS, within(cells, MAX_CELLS))
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", F.round("probability", 9).alias("probability"), _weight().alias("weight"), (F.col("draw") < F.col("probability")).alias("sampled"))


def _weight() -> Column:
    return F.when(F.col("probability") > 0, F.round(1 / F.col("probability"), 6))


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The sampled documents with their mix_probability, mix_weight and mix_tokens."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    held, own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED]).alias("held"), F.col("text")
    rows = docs.select(held, _dimension("source"), _dimension("lang"), topic_of(own).alias("topic"), tokens_of(own).alias("n_tokens"), draw(doc_id, F.xxhash64(text)).alias("draw"))
    rows = stored(rows, "tokens")
    cells = _cells(rows)
    joined = _joined(rows, _ratios(cells, targets), DIMENSIONS, within(cells, MAX_CELLS)).where("draw < probability")
    return joined.select("held.*", F.round("probability", 9).alias(ADDED[0]), _weight().alias(ADDED[1]), F.col("n_tokens").alias(ADDED[2]))
