"""Running columns over series of any length.

Rows go to range partitions of (key, order), so a key of very many rows is split over tasks. Windows run inside a
partition; what a partition needs from those before it comes from a summary row for each partition and key, of which only
a partition's first key needs any. So the carried table has at most one row a partition, and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..scratch import cut

_AT = ["__part", "__key"]


def _ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int) -> DataFrame:
    """df with its partition's number and its key (null equal to null), written, which fixes the partitions for all later reads."""
    keyed = df.withColumn("__key", F.struct(*[F.col(k) for k in keys], F.lit(0).alias("__0")))
    return cut(keyed.repartitionByRange(segments, "__key", *order).withColumn("__part", F.spark_partition_id()), "segments")


def _inside(order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*_AT).orderBy(*order)


def _carried(sums: DataFrame, over: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """sums: a row for each partition and key. The given columns over the rows of the same key's earlier partitions, where there are any."""
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    out = sums.select(*_AT, F.count("*").over(earlier).alias("__earlier"), *[f(earlier).alias(name) for name, f in over.items()])
    return F.broadcast(out.where("__earlier > 0").drop("__earlier"))


def lagged(df: DataFrame, value: Column, out: str, keys: Sequence[str], order: Sequence[str], segments: int) -> DataFrame:
    """Adds the value of the key's row before."""
    rows = _ranged(df.withColumn("__v", value), keys, order, segments)
    ends = rows.groupBy(*_AT).agg(F.max_by(F.struct("__v"), F.struct(*order)).alias("end"))
    before = _carried(ends, {"before": lambda w: F.last("end").over(w)})
    window = _inside(order)
    first = F.row_number().over(window) == 1
    both = rows.withColumns({"__first": first, "__lag": F.lag("__v").over(window)}).join(before, _AT, "left")
    return both.withColumn(out, F.when(F.col("__first"), F.col("before.__v")).otherwise(F.col("__lag"))).drop(*_AT, "__v", "__first", "__lag", "before")


def filled_forward(df: DataFrame, column: str, out: str, keys: Sequence[str], order: Sequence[str], segments: int) -> DataFrame:
    """Adds the last value of the key up to each row that isn't null."""
    rows = _ranged(df, keys, order, segments)
    ends = rows.groupBy(*_AT).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("end"))
    before = _carried(ends, {"before": lambda w: F.last("end", ignorenulls=True).over(w)})
    held = F.last(column, ignorenulls=True).over(_inside(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__held", held).join(before, _AT, "left").withColumn(out, F.coalesce("__held", "before")).drop(*_AT, "__held", "before")


def ewma_by_segments(df: DataFrame, column: str, span: int, out: str, keys: Sequence[str], order: Sequence[str], segments: int, block_decay: float) -> DataFrame:
    """bars.ewma over segments: a partition's means are a factor times the mean that it starts from, and an offset.

    Two things are carried. First how many rows lie before and which was the last with a value, as the old mean's share
    depends on the rows since. Then each partition's factor and offset, which are composed in order of the partitions.
    """
    a = 2 / (span + 1)
    window = _inside(order)
    upto, before = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(Window.unboundedPreceding, -1)
    v = F.col("__v")
    rows = _ranged(df.withColumn("__v", F.col(column).cast("double")), keys, order, segments).withColumn("__n", F.row_number().over(window))
    sums = rows.groupBy(*_AT).agg(F.count("*").alias("rows"), F.max(F.when(v.isNotNull(), F.col("__n"))).alias("last"))
    earlier = Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    given = _carried(sums.withColumn("last", F.col("start") + F.col("last")), {"__start": lambda w: F.sum("rows").over(w), "__last": lambda w: F.max("last").over(w)})
    rows = rows.withColumn("__was", F.last(F.when(v.isNotNull(), F.col("__n")), ignorenulls=True).over(before)).join(given, _AT, "left")
    start = F.coalesce("__start", F.lit(0))
    since = start + F.col("__n") - F.coalesce(start + F.col("__was"), "__last")
    first = since.isNull()
    q = F.pow(F.lit(1 - a), since)
    share = F.when(v.isNotNull(), F.when(first, F.lit(1.0)).otherwise(F.lit(a) / (q + a)))
    fall = F.when(v.isNull() | first, F.lit(0.0)).otherwise(F.greatest(F.log(q) - F.log(q + a), F.lit(-4 * block_decay)) if span > 1 else F.lit(-4 * block_decay))
    rows = rows.withColumns({"__share": share, "__fall": fall}).withColumn("__log", F.sum("__fall").over(upto))
    rows = rows.withColumn("__block", F.floor(-F.col("__log") / block_decay)).withColumn("__in", F.col("__log") + F.col("__block") * block_decay)
    block = Window.partitionBy(*_AT, "__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__sum", F.coalesce(F.sum(F.col("__share") * v * F.exp(-F.col("__in"))).over(block), F.lit(0.0)))
    rows = rows.withColumns({"__last_sum": F.lag("__sum").over(window), "__last_block": F.lag("__block").over(window)})
    rows = rows.withColumn("__from", F.first(F.struct("__last_sum", "__last_block")).over(block))
    held = F.coalesce(F.col("__from.__last_sum") * F.exp(block_decay * (F.col("__from.__last_block") - F.col("__block"))), F.lit(0.0))
    rows = rows.withColumns({"__offset": F.exp("__in") * (F.col("__sum") + held), "__factor": F.exp("__log")})
    rows = cut(rows.select(*df.columns, *_AT, *[c for c in order if c not in df.columns], "__v", "__offset", "__factor"), "segment-means")

    ends = rows.groupBy(*_AT).agg(F.min("__factor").alias("factor"), F.max_by("__offset", F.when(v.isNotNull(), F.struct(*order))).alias("offset"))
    lists = ends.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("__part", "factor", "offset"))).alias("x"))  # a partition's row each
    empty = F.struct(F.lit(None).cast("double").alias("mean"), F.array().cast("array<struct<part: int, mean: double>>").alias("out"))
    step = lambda acc, e: F.struct(
        F.coalesce(e["factor"] * acc["mean"] + e["offset"], e["offset"], acc["mean"]).alias("mean"), F.array_append(acc["out"], F.struct(e["__part"].alias("part"), acc["mean"].alias("mean"))).alias("out")
    )
    starts = lists.select("__key", F.explode(F.aggregate("x", empty, step)["out"]).alias("s")).select(F.col("s.part").alias("__part"), "__key", F.col("s.mean").alias("__mean")).where("__mean IS NOT NULL")
    both = rows.join(F.broadcast(starts), _AT, "left")
    mean = F.when(v.isNotNull(), F.col("__offset") + F.coalesce(F.col("__factor") * F.col("__mean"), F.lit(0.0)))
    both = both.withColumn("__own", mean).withColumn("__held", F.last("__own", ignorenulls=True).over(upto))
    return both.withColumn(out, F.coalesce("__held", "__mean")).drop(*_AT, "__v", "__offset", "__factor", "__mean", "__own", "__held")


def total_before(df: DataFrame, value: Column, out: str, keys: Sequence[str], order: Sequence[str], segments: int) -> DataFrame:
    """Adds the sum of value over the key's rows before (0 for its first)."""
    rows = _ranged(df.withColumn("__v", value), keys, order, segments)
    sums = rows.groupBy(*_AT).agg(F.sum("__v").alias("v"))
    before = _carried(sums, {"__before": lambda w: F.sum("v").over(w)})
    inside = F.sum("__v").over(_inside(order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__own", inside).join(before, _AT, "left").withColumn(out, F.coalesce("__before", F.lit(0)) + F.coalesce("__own", F.lit(0))).drop(*_AT, "__v", "__own", "__before")
