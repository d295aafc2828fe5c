"""Market tables: union, keys, order, summary and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import market_url, slug_variants, strip
from ..functions.values import flag, number
from .tables import exact_quantiles, first_by_key, first_present, percentile_ranks

# Fixed values of the data model: names by which a field may come, in order of preference.
ALIASES = {
    "condition_id": ("condition_id", "conditionId"),
    "liquidity": ("liquidity_clob", "liquidity_num", "liquidity"),
    "volume_total": ("volume_clob", "volume_num", "volume"),
    "volume_24h": ("volume24hr_clob", "volume24hr"),
    "volume_1w": ("volume1wk_clob", "volume1wk"),
    "spread": ("spread",),
    "created_at": ("created_at", "createdAt"),
    "end_date": ("end_date", "endDate"),
}
REQUIRED = {"identifier": ("condition_id", "conditionId", "id", "slug"), "question": ("question",), "liquidity": ALIASES["liquidity"], "volume_24h": ALIASES["volume_24h"], "spread": ALIASES["spread"]}
#: Fixed values of the data model: what each rank counts in the score; the spread has the rest.
WEIGHTS = {"volume_24h": 0.45, "liquidity": 0.25, "volume_1w": 0.20, "volume_total": 0.05}


def union_markets(active: DataFrame, inactive: DataFrame) -> DataFrame:
    """Active rows, then inactive ones, columns by name; state_order says which."""
    return active.withColumn("state_order", F.lit(0)).unionByName(inactive.withColumn("state_order", F.lit(1)), allowMissingColumns=True)


def market_key(df: DataFrame) -> Column:
    """The first of condition_id, id and slug that isn't blank."""
    held = [F.col(c).cast("string") for c in ("condition_id", "id", "slug") if c in df.columns]
    return F.coalesce(*[F.when(strip(c) != "", c) for c in held], F.lit(None).cast("string"))


def dedupe_markets(df: DataFrame, *order: Column) -> DataFrame:
    """The first row of each key in that order; rows without a key all stay."""
    return first_by_key(df, market_key(df), *order)


def sort_markets(df: DataFrame) -> DataFrame:
    key = F.coalesce(*[F.when(strip(F.col(c)) != "", F.col(c).cast("string")) for c in ("id", "condition_id") if c in df.columns], F.lit(""))
    return df.orderBy(F.col("created_at").asc_nulls_last(), key, F.coalesce("slug", F.lit("")))


def filter_created_at(df: DataFrame, floor: str | None) -> DataFrame:
    """Markets created at floor or later; with a floor, those without a time go."""
    return df if floor is None else df.where(F.col("created_at") >= F.lit(floor).cast("timestamp"))


def filter_market_state(df: DataFrame, **values: object) -> DataFrame:
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def filter_liquidity(df: DataFrame, min_liquidity: float | None = None, min_volume_24h: float | None = None) -> DataFrame:
    """Null fails a minimum."""
    if min_liquidity is not None:
        df = df.where(F.col("liquidity") >= min_liquidity)
    return df if min_volume_24h is None else df.where(F.col("volume_24h") >= min_volume_24h)


def schema_findings(df: DataFrame, required: Sequence[str] | None = None) -> list[tuple[str, str | None]]:
    """(field, the column that gives it or None): the listed columns, or else the ranking's fields by the first alias that is there."""
    wanted = {c: (c,) for c in required} if required else REQUIRED
    return [(field, next((n for n in names if n in df.columns), None)) for field, names in wanted.items()]


def rank_schema_check(df: DataFrame, required: Sequence[str] | None = None) -> list[tuple[str, str]]:
    """schema_findings where every field is found; ValueError with those that aren't."""
    found = schema_findings(df, required)
    missing = [field for field, column in found if column is None]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return found


def _typed(df: DataFrame) -> DataFrame:
    numbers = {c: number(first_present(df, ALIASES[c])) for c in ("liquidity", "volume_total", "volume_24h", "volume_1w", "spread")}
    texts = {"condition_id": first_present(df, ALIASES["condition_id"]).cast("string"), "slug": first_present(df, ["slug"]).cast("string"), "question": first_present(df, ["question"]).cast("string")}
    flags = {c: flag(F.col(c)) if c in df.columns else F.lit(False) for c in ("active", "closed", "archived")}
    times = {c: first_present(df, ALIASES[c]).try_cast("timestamp") for c in ("created_at", "end_date")}
    return df.select(*[c.alias(n) for n, c in (texts | flags | times | numbers).items()])


def created_at_offset(df: DataFrame, created_at: str) -> DataFrame:
    """rows_before: how many markets a listing in order of creation has before that time."""
    return df.agg(F.count_if(F.col("created_at") < F.lit(created_at).cast("timestamp")).alias("rows_before"))


def summarize_markets(df: DataFrame) -> DataFrame:
    """One row: totals, counts by state, sums (0 of nothing) and medians (null of nothing)."""
    typed = _typed(df)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    medians = exact_quantiles(typed, [], {"liquidity_median": (F.col("liquidity"), 0.5), "spread_median": (F.col("spread"), 0.5)}).select(F.struct("liquidity_median", "spread_median")).scalar()
    return typed.agg(
        F.current_timestamp().alias("generated_at_utc"), F.count("*").alias("markets_total"), F.count_if(F.col("active")).alias("markets_active"), F.count_if(~F.col("active")).alias("markets_inactive"),
        F.count_if(F.col("closed")).alias("markets_closed"), F.count_if(F.col("archived")).alias("markets_archived"), F.count_if(~F.col("closed")).alias("markets_open"),
        total("liquidity").alias("liquidity_total"), total("volume_total").alias("volume_total"), total("volume_24h").alias("volume_24h_total"), total("volume_1w").alias("volume_1w_total"),
    ).withColumn("__medians", medians).select("*", "__medians.*").drop("__medians")


def market_score(df: DataFrame) -> DataFrame:
    """Adds market_score from percentile ranks; a tighter spread is better, and a missing one counts as the tightest."""
    df = percentile_ranks(df, {c: f"{c}_pct" for c in (*WEIGHTS, "spread")})
    score = sum((F.col(f"{c}_pct") * w for c, w in WEIGHTS.items()), F.lit(0.0)) + (1 - F.col("spread_pct")) * 0.05
    return df.withColumn("market_score", score)


def rank_markets(df: DataFrame, top_n: int = 25, min_liquidity: float | None = None, min_volume_24h: float | None = None, required: Sequence[str] | None = None, validate: bool = False) -> DataFrame:
    """The top_n markets by score (all if 0 or less); ranks are taken over the rows left after the minimums."""
    if validate:
        rank_schema_check(df, required)
    ranked = market_score(filter_liquidity(_typed(df), min_liquidity, min_volume_24h))
    order = [F.col(c).desc_nulls_last() for c in ("market_score", "volume_24h", "liquidity", "created_at")] + [F.col("condition_id"), F.col("slug")]
    out = ranked.orderBy(*order)
    out = out.limit(top_n) if top_n > 0 else out
    return out.select("condition_id", "slug", "question", "active", "closed", "liquidity", "volume_24h", "volume_1w", "volume_total", "spread", "market_score", "end_date")


def lookup_market(markets: DataFrame, wanted: DataFrame) -> DataFrame:
    """The market of each wanted condition_id, its case as it is; an active one before others."""
    found = wanted.select("condition_id").distinct().join(markets, "condition_id")
    return first_by_key(found, F.col("condition_id"), (~F.col("active")).cast("int"), F.col("slug"))


def resolve_url_markets(urls: DataFrame, markets: DataFrame, events: DataFrame | None = None, url_col: str = "url") -> DataFrame:
    """The markets that each distinct url stands for: the market of a market page, all markets of an event page's event in their order.

    A page's slug is tried as it is, then without a last number; the first that exists counts, for events the first that has a
    list of markets. events: slug and markets, an array of structs with slug and condition_id (null: no list). Of markets or
    events with one slug the least counts.

    Returns url_col, kind, slug (the one found), pos, market_slug, condition_id and status: "ok", "no condition id" of a market
    without one, or, in the url's only row, "no market or event page", "not found", "no list of markets", "no markets".
    """
    asked = urls.select(F.col(url_col).alias("url"), market_url(F.col(url_col)).alias("p")).distinct().select("url", "p.kind", "p.slug")
    named = markets.select("slug", F.col("condition_id").cast("string").alias("condition_id")).where("slug IS NOT NULL").groupBy("slug").agg(F.min("condition_id").alias("condition_id"))
    if events is None:
        events = markets.sparkSession.createDataFrame([], "slug string, markets array<struct<slug:string,condition_id:string>>")
    fields = F.transform("markets", lambda m: F.struct(m["slug"].cast("string").alias("slug"), m["condition_id"].cast("string").alias("condition_id")))
    lists = events.select("slug", fields.alias("markets")).where("slug IS NOT NULL").groupBy("slug").agg(F.min("markets").alias("markets"))
    there = named.select(F.lit("market").alias("kind"), "slug", F.lit(True).alias("listed")).unionByName(lists.select(F.lit("event").alias("kind"), "slug", F.col("markets").isNotNull().alias("listed")))
    tried = asked.where("kind IS NOT NULL").select("url", "kind", F.posexplode(slug_variants(F.col("slug"))).alias("place", "slug")).join(there, ["kind", "slug"], "left")
    hits = tried.groupBy("url", "kind").agg(F.min_by("slug", F.when(F.col("listed"), F.col("place"))).alias("slug"), F.count("listed").alias("n_there"))

    none, columns = F.lit(None).cast("string"), ["url", "kind", "slug", "pos", "market_slug", "condition_id", "status"]
    of_market = hits.where("kind = 'market' AND slug IS NOT NULL").join(named, "slug").select("url", "kind", "slug", F.lit(0).alias("pos"), F.col("slug").alias("market_slug"), "condition_id", F.lit(True).alias("held"))
    of_event = hits.where("kind = 'event' AND slug IS NOT NULL").join(lists, "slug").select("url", "kind", "slug", F.posexplode_outer("markets").alias("pos", "m"))
    of_event = of_event.select("url", "kind", "slug", "pos", F.col("m.slug").alias("market_slug"), "m.condition_id", F.col("pos").isNotNull().alias("held"))
    found = of_market.unionByName(of_event).withColumn("status", F.when(~F.col("held"), "no markets").when(F.col("condition_id").isNull(), "no condition id").otherwise("ok"))
    missing = hits.where("slug IS NULL").withColumn("status", F.when(F.col("n_there") > 0, "no list of markets").otherwise("not found"))
    other = asked.where("kind IS NULL").withColumn("status", F.lit("no market or event page"))
    rest = [df.select("url", "kind", none.alias("slug"), F.lit(None).cast("int").alias("pos"), none.alias("market_slug"), none.alias("condition_id"), "status") for df in (missing, other)]
    return found.select(columns).unionByName(rest[0]).unionByName(rest[1]).withColumnRenamed("url", url_col)


def pick_market(events: DataFrame, index: int | None = None, slug: str | None = None) -> DataFrame:
    """One market of each event (columns event, pos, slug, condition_id): by slug, else by index, else the only one; status says why there is none."""
    chosen = F.col("slug") == slug if slug is not None else F.col("pos") == index if index is not None else F.lit(True)
    picked = events.groupBy("event").agg(F.count("*").alias("n"), F.count_if(chosen).alias("hits"), F.min_by("condition_id", F.when(chosen, F.col("pos"))).alias("condition_id"))
    one = slug is not None or index is not None
    status = F.when(F.col("hits") == 0, "not found").when((F.lit(not one)) & (F.col("n") > 1), "choose one by slug or index").when(F.col("condition_id").isNull(), "no condition id").otherwise("ok")
    return picked.select("event", status.alias("status"), F.when(status == "ok", F.col("condition_id")).alias("condition_id"))


def market_preview(df: DataFrame, event_col: str, markets_col: str) -> DataFrame:
    """Index, slug, condition id and question of the markets of each event."""
    return df.select(event_col, F.posexplode(markets_col).alias("pos", "m")).select(event_col, "pos", "m.slug", "m.condition_id", "m.question")
