"""Generic table operators: columns, filters, dedupe, ordering, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import snake_case
from ..functions.values import iso_ts
from ..scratch import cut


def _snake_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(snake_case(f.name), _snake_type(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_snake_type(kind.elementType), kind.containsNull)
    return kind


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Column and nested field names to snake_case; only names change."""
    return df.select([F.col(f"`{f.name}`").cast(_snake_type(f.dataType)).alias(snake_case(f.name)) for f in df.schema.fields])


def select_existing(df: DataFrame, names: Sequence[str], fill: bool = False) -> DataFrame:
    """The named columns that exist, in that order; fill: those that don't as null text."""
    return df.select([F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in names if fill or c in df.columns])


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that exists, not the first value; null text if none does."""
    return next((F.col(f"`{c}`") for c in names if c in df.columns), F.lit(None).cast("string"))


#: Fixed values of the data model: columns that hold times wherever they come as text.
TIME_COLUMNS = [
    "created_at", "createdAt", "updated_at", "updatedAt", "end_date", "endDate", "start_date", "startDate", "closed_time", "closedTime",
    "end_date_iso", "endDateIso", "start_date_iso", "startDateIso", "timestamp_utc", "timestamp",
]


def parse_time_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: iso_ts(F.col(f.name)) for f in df.schema.fields if f.name in TIME_COLUMNS and isinstance(f.dataType, T.StringType)})


def dedupe_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows by those columns, null equal to null."""
    return df.dropDuplicates(list(columns))


def first_by_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in that order, and every row without a key.

    The rows of a key come together only as one struct a task: a minimum is taken on both sides of the shuffle, so a
    key that very many rows share does not gather them.
    """
    names = df.columns
    keyed = df.withColumn("__key", key)
    ordering = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    best = keyed.where(F.col("__key").isNotNull()).groupBy("__key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), ordering).alias("row"))
    return best.select("row.*").unionByName(keyed.where(F.col("__key").isNull()).drop("__key"))


def merge_sides(df: DataFrame, side_rank: Column, id_col: str, time_col: str, n: int | None = None) -> DataFrame:
    """One row for each id, that of the smallest side rank, newest first; the first n."""
    merged = df.groupBy(id_col).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(side_rank, F.col(time_col))).alias("row")).select("row.*")
    merged = merged.orderBy(F.col(time_col).desc(), F.col(id_col).desc())
    return merged.limit(n) if n else merged


def keyset_page(df: DataFrame, time_col: str, id_col: str, n: int, cursor: tuple | None = None) -> DataFrame:
    """The next n rows, newest first, after a cursor (time, id)."""
    if cursor is not None:
        time, last = cursor
        df = df.where((F.col(time_col) < F.lit(time)) | ((F.col(time_col) == F.lit(time)) & (F.col(id_col) < F.lit(last))))
    return df.orderBy(F.col(time_col).desc(), F.col(id_col).desc()).limit(n)


def offset_page(df: DataFrame, order: Sequence[Column], offset: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), column)


#: Rows up to which a counted table goes out to all executors, and rows that one task sorts or hashes.
BROADCAST_ROWS, TASK_ROWS = 100_000, 400_000


def small_side(df: DataFrame, label: str) -> DataFrame:
    """df written, for a join with a large table on keys of which each may have very many rows there: broadcast if it was counted to be small."""
    held = cut(df, label)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def task_partitions(df: DataFrame, rows: int) -> int:
    """How many partitions rows need. By rows, as sorted rows compress to a hundredth on their way, and a size in bytes lets a task have millions."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


#: Relative rank error of the sketches that bracket a quantile, as its reciprocal; brackets reach BRACKET errors to both sides.
SKETCH, BRACKET = 10_000, 4


def exact_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """One row a key (one row in all without keys) with quantiles by linear interpolation; null where a key has no value.

    wanted: name -> (value, fraction). By selection, in two passes: a sketch of each key brackets every quantile between
    two values; then what lies below and above a bracket is only counted, and the values inside it, at most about one in a
    thousand of a key's and ties as one row, are ranked. Neither a key nor a column is sorted or held whole, and rows do not
    move to their key's bracket: brackets go out to them where there are few. The first pass runs here if there are keys, the
    second with the result, so callers write an input that is dear to compute.
    """
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("k"))
    columns = list({str(c): c for c, _ in wanted.values()}.values())
    number = {str(c): k for k, c in enumerate(columns)}
    fractions = [sorted({f for c, f in wanted.values() if number[str(c)] == k}) for k in range(len(columns))]
    base = df.select(key.alias("key"), *[c.cast("double").alias(f"v{k}") for k, c in enumerate(columns)])
    reach = BRACKET / SKETCH
    ends = [[F.lit(e) for f in fs for e in (max(0.0, f - reach), min(1.0, f + reach))] for fs in fractions]
    sketch = base.groupBy("key").agg(*[F.percentile_approx(f"v{k}", F.array(*e), SKETCH).alias(f"s{k}") for k, e in enumerate(ends)])
    sketch = small_side(sketch, "sketches") if keys else F.broadcast(sketch)

    pairs = [(k, j) for k, fs in enumerate(fractions) for j in range(len(fs))]
    sided = []
    for no, (k, j) in enumerate(pairs):
        v, low, high = F.col(f"v{k}"), F.col(f"s{k}")[2 * j], F.col(f"s{k}")[2 * j + 1]
        side = F.when(v < low, -1).when(v > high, 1).otherwise(0)
        sided.append(F.when(v.isNotNull(), F.struct(F.lit(no).alias("no"), side.alias("side"), v.alias("v"))))
    long = base.join(sketch, "key").select("key", F.explode(F.array_compact(F.array(*sided))).alias("x")).select("key", "x.*")
    counts = long.groupBy("key", "no", "side", F.when(F.col("side") == 0, F.col("v")).alias("inside")).agg(F.count("*").alias("ties"), F.min("v").alias("least"), F.max("v").alias("most"))
    own = Window.partitionBy("key", "no")
    ranks = counts.repartition("key").withColumns({"upto": F.sum("ties").over(own.orderBy("side", "inside").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("ties").over(own)})

    def at(no: int, rank: Column) -> Column:
        """The value of that rank (from 0): inside the bracket, or the one next to it on either side."""
        first, last = F.col("upto") - F.col("ties"), F.col("upto") - 1
        near = F.when(F.col("side") == 0, F.col("inside")).when((F.col("side") < 0) & (rank == last), F.col("most")).when((F.col("side") > 0) & (rank == first), F.col("least"))
        near = F.coalesce(near, F.raise_error(F.lit("a quantile lies outside of its sketch's bracket")).cast("double"))
        return F.max(F.when((F.col("no") == no) & (rank >= first) & (rank <= last), near))

    out = []
    for name, (c, fraction) in wanted.items():
        no = pairs.index((number[str(c)], fractions[number[str(c)]].index(fraction)))
        place = F.lit(fraction) * (F.col("n") - 1)
        part = F.max(F.when(F.col("no") == no, place - F.floor(place)))
        out.append((at(no, F.floor(place)) * (1 - part) + at(no, F.ceil(place)) * part).alias(name))
    if keys:
        return ranks.groupBy("key").agg(*out).select(*[F.col("key").getField(k).alias(k) for k in keys], *wanted)
    return ranks.agg(*out)


def describe_column(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, standard deviation, least, quartiles, greatest and total of a column, exactly."""
    c = F.col(column)
    plain = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.sum(c).alias("total"))
    quartiles = exact_quantiles(df, [], {"q25": (c, 0.25), "q50": (c, 0.5), "q75": (c, 0.75)}).select(F.struct("q25", "q50", "q75")).scalar()
    return plain.withColumn("q", quartiles).select("n", "mean", "std", "least", "q.q25", "q.q50", "q.q75", "greatest", "total")


def time_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min(column).alias("first_time"), F.max(column).alias("last_time"))


def percentile_ranks(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Average-method percentile rank of each column over its values that aren't null, under the given name; null gets 0.

    Rows get numbers. Each value goes with its row's number through one range partition of (column, value, row), so that
    the rows of a common value are split too; a partition's places start from the totals of those before it, and a value
    that reaches over partitions (two a partition at most) gets its first and last place from them all. One aggregation
    brings a row's ranks together for the join with the rows. Rows are counted for the number of partitions in all of it.
    """
    rows = cut(df.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    n = task_partitions(rows, rows.count() * len(columns))
    long = rows.select("__row", F.explode(F.array(*[F.struct(F.lit(k).alias("no"), F.col(c).cast("double").alias("value")) for k, c in enumerate(columns)])).alias("x")).select("__row", "x.*").where("value IS NOT NULL")
    ranged = cut(long.repartitionByRange(n, "no", "value", "__row").withColumn("part", F.spark_partition_id()), "ranged")
    parts = ranged.groupBy("no", "part").agg(F.count("*").alias("in_part"), F.min("value").alias("low"), F.max("value").alias("high"))  # a row for each column and partition
    upto = Window.partitionBy("no").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"before": F.coalesce(F.sum("in_part").over(upto), F.lit(0)), "n": F.sum("in_part").over(Window.partitionBy("no"))})
    inside, tied = Window.partitionBy("no", "part").orderBy("value"), Window.partitionBy("no", "part", "value")
    placed = ranged.repartitionById(n, F.col("part")).withColumns({"first": F.rank().over(inside), "ties": F.count("*").over(tied)}).join(F.broadcast(parts), ["no", "part"])
    placed = placed.withColumns({"first": F.col("before") + F.col("first"), "edge": (F.col("value") == F.col("low")) | (F.col("value") == F.col("high"))}).withColumn("last", F.col("first") + F.col("ties") - 1)
    over = placed.where("edge").groupBy("no", "value").agg(F.min("first").alias("all_first"), F.max("last").alias("all_last"))
    ranked = placed.join(F.broadcast(over), ["no", "value"], "left").withColumn("rank", (F.coalesce("all_first", "first") + F.coalesce("all_last", "last")) / 2 / F.col("n"))
    wide = ranked.repartition(n, "__row").groupBy("__row").agg(*[F.max(F.when(F.col("no") == k, F.col("rank"))).alias(out) for k, out in enumerate(columns.values())])
    return rows.repartition(n, "__row").join(wide, "__row", "left").drop("__row").fillna(0.0, list(columns.values()))


def percentile_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    return percentile_ranks(df, {column: out})
