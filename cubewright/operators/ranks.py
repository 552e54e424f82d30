"""Ranks over an entire relation without moving it to one task.

The values' approximate quantiles cut the order into buckets; a row's position
is its position in its bucket plus the sizes of the buckets before. The cuts
only balance the buckets: the result doesn't depend on them.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubewright.plans.context import match, q

#: Relations that Spark estimates below this many bytes are ranked by one window.
SMALL = 64 << 20
CUTS = [i / 200 for i in range(1, 200)]
#: Relations of at most this many rows are numbered by one window.
ROWS = 1 << 20
#: About so many buckets, cut by so many rows each.
BUCKETS, EACH = 256, 100
#: A row that is taken more often than this is repeated in several runs.
REPEAT = 4096
#: Wanted buckets in at most so many runs are fetched by bounds on the first sort key.
RUNS = 16


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def running(df: DataFrame, value: str, weight: str, down: bool, numeric: bool, size: int) -> DataFrame:
    """``df`` of distinct values with __before (weights of the values ahead) and __row (its 1-based position).

    ``size``: bytes of the tables whose rows the values come from.
    """
    order = F.col(value).desc() if down else F.col(value).asc()
    if not numeric or size < SMALL:
        over = Window.orderBy(order)
        ahead = F.sum(weight).over(over.rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("__before", F.coalesce(ahead, F.lit(0))).withColumn("__row", F.row_number().over(over))
    cuts = df.agg(F.percentile_approx(F.col(value).cast("double"), CUTS, 10_000).alias("__cuts"))
    passed = F.size(F.filter("__cuts", lambda c: c < F.col(value).cast("double")))
    cut = df.crossJoin(F.broadcast(cuts)).withColumn("__bucket", -passed if down else passed).drop("__cuts")
    totals = cut.groupBy("__bucket").agg(F.sum(weight).alias("__w"), F.count(F.lit(1)).alias("__n"))
    ahead = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    totals = totals.select(F.col("__bucket").alias("__of"), F.coalesce(F.sum("__w").over(ahead), F.lit(0)).alias("__w0"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0"))
    within = Window.partitionBy("__bucket").orderBy(order)
    here = F.coalesce(F.sum(weight).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = cut.join(F.broadcast(totals), F.col("__bucket") == F.col("__of"))
    return out.withColumn("__before", F.col("__w0") + here).withColumn("__row", F.col("__n0") + F.row_number().over(within)).drop("__bucket", "__of", "__w0", "__n0")


def many_rows(df: DataFrame) -> int:
    """The number of rows if it is beyond ROWS, else 0. Bytes tell nothing here: files hold 100 rows a byte where values repeat."""
    most = df._jdf.queryExecution().optimizedPlan().maxRows()
    n = df.count() if most.isEmpty() or int(str(most.get())) > ROWS else 0
    return n if n > ROWS else 0


#: A sort key: the column's name and whether it descends. BLANK is smallest.
SortKey = tuple[str, bool]


def sorting(keys: Iterable[SortKey]) -> list[Column]:
    return [q(c).desc_nulls_last() if down else q(c).asc_nulls_first() for c, down in keys]


def value_of(df: DataFrame) -> Column:
    """The one value of ``df`` as a literal; an array joined to a relation would be copied into each of its rows."""
    row, kind = df._jdf.queryExecution().executedPlan().executeCollect()[0], df._jdf.schema().apply(0).dataType()
    sql = df.sparkSession._jvm.org.apache.spark.sql
    return Column(sql.classic.ExpressionUtils.column(sql.catalyst.expressions.Literal(row.get(0, kind), kind)))


def distinct_keys(keys: list[SortKey]) -> list[SortKey]:
    first = dict(reversed(keys))  # a column that comes again orders nothing
    return [(c, first[c]) for c in dict.fromkeys(c for c, _ in keys)]


def cuts_of(df: DataFrame, n: int, keys: list[SortKey]) -> Column:
    """Rows sampled from the ``n`` of ``df``, in order, as an array of k0, k1, ... for ``keys``; they only balance the buckets."""
    some = df.select(*[q(c) for c, _ in keys]).sample(fraction=min(1.0, BUCKETS * EACH / n), seed=7)
    some = some.withColumn("__r", F.row_number().over(Window.orderBy(*sorting(keys)))).where(F.col("__r") % EACH == 0)
    return value_of(some.agg(F.array_sort(F.collect_list(F.struct("__r", *[q(c).alias(f"k{i}") for i, (c, _) in enumerate(keys)])))))


def bucket_of(cuts: Column, keys: list[SortKey]) -> Column:
    """The number of cuts before the row, by binary search on all keys: only rows equal in all of them can't be parted."""

    def searched(cuts: Column) -> Column:
        def search(bucket: Column, step: Column) -> Column:
            cut, passed = F.get(cuts, bucket + step - 1), F.lit(False)
            for i, (c, down) in reversed(list(enumerate(keys))):
                have, own = cut[f"k{i}"], q(c)
                ahead = F.coalesce(have > own, have.isNotNull() & own.isNull()) if down else F.coalesce(have < own, have.isNull() & own.isNotNull())
                passed = ahead | (have.eqNullSafe(own) & passed)
            return F.when((bucket + step <= F.size(cuts)) & passed, bucket + step).otherwise(bucket)

        # A fold, as chained columns would be multiplied out when a filter is pushed through them.
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search)

    steps = [1 << i for i in range(BUCKETS.bit_length())][::-1]
    return F.transform(F.array(cuts), searched)[0]  # the cuts stand once in the plan


def bucketed(df: DataFrame, n: int, keys: list[SortKey]) -> DataFrame:
    """``df`` of ``n`` rows with __bucket, which ascends in the order of ``keys``."""
    keys = distinct_keys(keys)
    return df.withColumn("__bucket", bucket_of(cuts_of(df, n, keys), keys))


def numbered(df: DataFrame, parts: list[str], orders: list[SortKey], ties: list[str], names: list[str]) -> DataFrame:
    """``df`` with row number, rank, dense rank and number of rows in the partition ``parts``, as columns ``names``.

    Row numbers follow ``orders`` and then ``ties``, ranks ``orders`` alone.
    """
    at, rank, dense, of = names
    rows = [*orders, *((t, False) for t in ties)]
    orders = orders or rows
    n = many_rows(df)
    if not n:
        base = Window.partitionBy(*map(q, parts))
        ranked = base.orderBy(*sorting(orders))
        return df.select("*", F.row_number().over(base.orderBy(*sorting(rows))).alias(at), F.rank().over(ranked).alias(rank), F.dense_rank().over(ranked).alias(dense), F.count(F.lit(1)).over(base).alias(of))
    # Numbers within a bucket, then each bucket's own: what lies before it, and whether its first rows tie with the last ones there.
    cut = bucketed(df, n, [*((c, False) for c in parts), *rows])
    within = Window.partitionBy(*map(q, parts), "__bucket")
    within_rank = within.orderBy(*sorting(rows))  # one sort serves all three
    value = F.struct(*[q(c).alias(f"k{i}") for i, (c, _) in enumerate(orders)])
    new = ~F.coalesce(F.lag(value).over(within_rank).eqNullSafe(value), F.lit(False)) | (F.row_number().over(within_rank) == 1)
    local = cut.select("*", F.row_number().over(within_rank).alias(at), new.cast("int").alias("__new"))
    upto = within_rank.rowsBetween(Window.unboundedPreceding, 0)
    local = local.select("*", F.max(F.when(F.col("__new") == 1, q(at))).over(upto).alias(rank), F.sum("__new").over(upto).alias(dense)).drop("__new")
    ends = local.groupBy(*map(q, parts), "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.max(q(rank)).alias("__r"), F.max(q(dense)).alias("__d"), F.min_by(value, q(at)).alias("__first"), F.max_by(value, q(at)).alias("__last"))
    over = Window.partitionBy(*map(q, parts)).orderBy("__bucket")
    prior = over.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    ends = ends.withColumn("__tied", F.coalesce(F.lag("__last").over(over).eqNullSafe(F.col("__first")) & (F.row_number().over(over) > 1), F.lit(False)).cast("int"))
    ends = ends.withColumn("__rows0", F.coalesce(F.sum("__n").over(prior), none)).withColumn("__dense0", F.coalesce(F.sum(F.col("__d") - F.col("__tied")).over(prior), none) - F.col("__tied"))
    begun = F.when((F.col("__tied") == 0) | (F.col("__d") > 1), F.col("__rows0") + F.col("__r"))
    ends = ends.withColumn("__rank0", F.last(begun, ignorenulls=True).over(prior)).withColumn("__of", F.sum("__n").over(Window.partitionBy(*map(q, parts))))
    ends = ends.select(*[q(c).alias(f"__p{i}") for i, c in enumerate(parts)], F.col("__bucket").alias("__b"), "__tied", "__rows0", "__dense0", "__rank0", "__of")
    joined = local.join(ends, match([*((c, f"__p{i}") for i, c in enumerate(parts)), ("__bucket", "__b")]))
    ranks = F.when((F.col("__tied") == 1) & (q(rank) == 1), F.col("__rank0")).otherwise(F.col("__rows0") + q(rank))
    return joined.select(*map(q, df.columns), (F.col("__rows0") + q(at)).alias(at), ranks.alias(rank), (F.col("__dense0") + q(dense)).alias(dense), F.col("__of").alias(of))


def near_buckets(df: DataFrame, cuts: Column, key: SortKey, runs: list[tuple[int, int]]) -> DataFrame:
    """The rows of ``df`` whose first sort key may lie in the ``runs`` of buckets (first, last); scans skip files by it."""
    (c, down), found = key, F.lit(False)
    own = q(c)
    for first, last in runs:
        low, high, ends = F.get(cuts, F.lit(first - 1))["k0"], F.get(cuts, F.lit(last))["k0"], F.size(cuts) <= last
        if down:
            after, until = F.when(low.isNull(), own.isNull()).otherwise(own.isNull() | (own <= low)), high.isNull() | (own >= high)
        else:
            after, until = low.isNull() | (own >= low), F.when(high.isNull(), own.isNull()).otherwise(own.isNull() | (own <= high))
        found |= (after if first else F.lit(True)) & (ends | until)
    if df.select(own).dtypes[0][1] in ("float", "double"):
        found |= F.isnan(own)  # statistics of files may leave NaN out
    return df.where(found)


def sizes_of(df: DataFrame, cuts: Column, keys: list[SortKey]) -> dict[int, int]:
    return {r["__bucket"]: r["count"] for r in df.select(bucket_of(cuts, keys).alias("__bucket")).groupBy("__bucket").count().collect()}


def distinct_rows(held: DataFrame, n: int, keys: list[SortKey]) -> DataFrame:
    """The ``n`` rows of ``held`` by __bucket, equal ones as one with __copies, their number, and __row, the last one's position in the bucket.

    They are dealt out by number before they are grouped: a split of a well-packed file holds more of them than a task should.
    """
    names = [q(c) for c, _ in keys]
    held = held.repartition(2 + n // (ROWS // 4), *names).groupBy("__bucket", *names).agg(F.count(F.lit(1)).alias("__copies"))
    upto = Window.partitionBy("__bucket").orderBy(*sorting(keys)).rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("__row", F.sum("__copies").over(upto))


def evenly_spaced(df: DataFrame, n: int, keys: list[SortKey], count: int) -> DataFrame:
    """``count`` rows of the ``n`` of ``df``, those at the 0-based positions round(i * (n - 1) / (count - 1)); neither is listed.

    ``keys`` name all columns that are returned, and 1 < ``count`` < ``n``.
    """
    keys = distinct_keys(keys)
    if count <= BUCKETS:
        # Python's round() takes halves to even numbers, as bround() does.
        return at_positions(df, n, keys, [round(i * (n - 1) / (count - 1)) for i in range(count)])
    cuts = cuts_of(df, n, keys)
    sizes = sizes_of(df, cuts, keys)
    begun = [0, *accumulate(sizes.get(b, 0) for b in range(max(sizes)))]

    def before(at: Column) -> Column:
        """The number of positions below ``at``: by division, give or take one."""
        low = F.greatest(F.floor(at * F.lit(float(count - 1)) / F.lit(float(n - 1))) - 1, F.lit(0))
        own = [low + k for k in range(4)]
        return low + sum((((i < count) & (F.bround(i * F.lit(float(n - 1)) / F.lit(float(count - 1))) < at)).cast("long") for i in own), F.lit(0))

    names = [q(c) for c, _ in keys]
    held = distinct_rows(df.select(*names, bucket_of(cuts, keys).alias("__bucket")), n, keys)
    end = F.get(F.array(*[F.lit(b).cast("long") for b in begun]), F.col("__bucket")) + F.col("__row")
    taken = held.withColumn("__times", before(end) - before(end - F.col("__copies"))).where(F.col("__times") > 0)
    # A row that is taken very often is dealt out in runs, so that no array grows with it.
    runs = taken.select(*names, "__times", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1, F.lit(REPEAT).cast("long"))).alias("__from"))
    return runs.select(*names, F.explode(F.array_repeat(F.lit(0), F.least(F.lit(REPEAT), F.col("__times") - F.col("__from")).cast("int"))).alias("__again")).select(*names)


def at_positions(df: DataFrame, n: int, keys: list[SortKey], positions: list[int]) -> DataFrame:
    """The rows of ``df``, of ``n`` rows, at the 0-based ``positions`` of the order; only buckets that hold one are sorted.

    ``keys`` name all columns that are returned. Rows equal in all of them are one row with its number, so copies don't fill a task.
    """
    keys = distinct_keys(keys)
    cuts = cuts_of(df, n, keys)
    sizes = sizes_of(df, cuts, keys)
    wanted, runs, before, todo = [], [], 0, sorted(set(positions))[::-1]
    for b in sorted(sizes):
        held = len(wanted)
        while todo and todo[-1] < before + sizes[b]:
            wanted.append((b, todo.pop() - before + 1))
        if len(wanted) > held:
            runs = [*runs[:-1], (runs[-1][0], b)] if runs and runs[-1][1] == b - 1 else [*runs, (b, b)]
        before += sizes[b]
    near = near_buckets(df, cuts, keys[0], runs) if len(runs) <= RUNS else df
    names = [q(c) for c, _ in keys]
    held = near.select(*names, bucket_of(cuts, keys).alias("__bucket")).where(F.col("__bucket").isin([b for b, _ in wanted]))
    held = distinct_rows(held, sum(sizes[b] for b in {b for b, _ in wanted}), keys)
    asked = df.sparkSession.createDataFrame(wanted, "__in int, __want long")
    last = F.col("__row") - F.col("__want")
    return held.join(F.broadcast(asked), (F.col("__bucket") == F.col("__in")) & (last >= 0) & (last < F.col("__copies"))).select(*names)
