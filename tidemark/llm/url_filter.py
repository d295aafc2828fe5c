"""URLs judged by rules of hosts and paths, and by a list of URLs behind a blocked Bloom filter. DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_url
from .shared import cut, partitions

#: A block of the filter is a cache line: 8 words of 64 bits, of which every URL sets one bit each.
WORDS, WORD_BITS = 8, 64
#: Rows and bytes up to which a counted table goes out to all executors; beyond, joins are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20

_A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_AFTER_SCHEME = r"://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """allow or block what lies on a host or its subdomains under a path that starts so."""

    verdict: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null and without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _AFTER_SCHEME, 1), F.lit("")), *_A_Z)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null and without ://."""
    return F.coalesce(F.regexp_extract(url, _AFTER_SCHEME, 2), F.lit(""))


def _first_fit(rules: Sequence[Rule]) -> Column:
    """(text, verdict) of the longest rule that fits columns host and path; null if none does. A block comes before an allow of equal text."""
    longest = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), -len(r.host), r.verdict != "block", r))
    found = None
    for r in longest:
        fits = ((F.col("host") == r.host) | F.col("host").endswith(f".{r.host}")) & F.col("path").startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("text"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<text: string, verdict: string>") if found is None else found


def _bits(blocks: int) -> list[Column]:
    """The block of column canonical, and its bit in each word."""
    block = F.expr(f"(shiftrightunsigned(xxhash64(canonical), 32) * {blocks}L) div 4294967296L").alias("block")
    return [block, *[F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(canonical, 1), {6 * k}) & {WORD_BITS - 1} AS int))").alias(f"w{k}") for k in range(WORDS)]]


def blocked_bloom(listed: DataFrame, n: int, bits_per_url: int = 16) -> tuple[DataFrame, int]:
    """The filter over listed's column canonical, n rows: its blocks that aren't empty (block, w0 to w7), and how many blocks there are.

    With 16 bits for each URL about one unlisted URL in a thousand passes; a listed one always does.
    """
    blocks = max(1, -(-n * bits_per_url // (WORDS * WORD_BITS)))
    return listed.select(*_bits(blocks)).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]), blocks


def with_may(urls: DataFrame, bloom: DataFrame, blocks: int, small: bool) -> DataFrame:
    """Adds may: true where the filter has all bits of column canonical, else null. small: the filter was counted and goes out to all executors."""
    named = bloom.select(F.col("block").alias("__block"), *[F.col(f"w{k}").alias(f"__w{k}") for k in range(WORDS)], F.lit(True).alias("may"))
    block, *bits = _bits(blocks)
    all_set = block == F.col("__block")
    for k, bit in enumerate(bits):
        all_set &= F.col(f"__w{k}").bitwiseAND(bit) == bit
    return urls.join(F.broadcast(named) if small else named, all_set, "left").select(*urls.columns, "may")


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), id_col: str = "page_id", url_col: str = "url", listed_col: str = "url",
    bits_per_url: int = 16, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Judges every page's url: by the longest rule that fits it, else block if its canonical form is that of a listed url, else allow.

    Listed URLs become one row each in canonical form. Pages' URLs that no rule fits are tested against a blocked Bloom
    filter of them; what passes is summed to one row for each URL, so that no URL is hot, and joined exactly with the list,
    which removes the filter's false positives. What is found goes back to the pages: by broadcast where its size was
    checked, else by a shuffle of what may be listed, in which URLs with very many pages, of which there can be only a few for
    each shuffle partition, are broadcast.

    Returns one row per input row: the id column, host, path, rule (host and path of the rule that fits, else null) and
    verdict (allow or block). Rules are a parameter, for up to some hundreds.

    A null url, an empty one or one without :// has an empty host and path, fits no rule and isn't listed: allow. Repeated
    rows and ids are judged each for itself; null ids stay. Null URLs in the list, repeated ones and such without a host
    list nothing more. An empty list leaves the rules; an empty table gives an empty table. Other columns are neither read
    nor kept, so their names don't matter.
    """
    known = listed.select(canonical_url(F.col(f"`{listed_col}`").cast("string")).alias("canonical")).where("canonical IS NOT NULL").distinct()
    known = cut(known, "listed-urls")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    rows = rows.select("id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path")).withColumn("rule", _first_fit(rules))
    rows = rows.withColumn("canonical", F.when(F.col("rule").isNull() & (F.instr("url", "://") > 0), canonical_url(F.col("url"))))

    bloom, blocks = blocked_bloom(known, known.count(), bits_per_url)
    small = blocks <= broadcast_rows
    if small:
        rows = with_may(rows, bloom, blocks, small)
        counts = cut(_counts(rows.where("may")), "asked-urls")
        passed = counts
    else:  # a block is a key of the shuffle, so a URL goes there once; the pages' rows are not tested
        rows = rows.withColumn("may", F.col("canonical").isNotNull())
        counts = cut(_counts(rows.where("may")), "asked-urls")
        passed = with_may(counts, bloom, blocks, small).where("may").drop("may")
    hits = cut(passed.join(known, "canonical", "left_semi").select("canonical", F.lit(True).alias("hit")), "listed-hits")
    judged = _with_hits(rows, hits, counts, broadcast_rows)
    verdict = F.when(F.col("rule").isNotNull(), F.col("rule.verdict")).when(F.col("hit"), "block").otherwise("allow")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("rule.text").alias("rule"), verdict.alias("verdict"))


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("canonical").agg(F.count("*").alias("n"))


def _with_hits(rows: DataFrame, hits: DataFrame, counts: DataFrame, broadcast_rows: int) -> DataFrame:
    """Adds hit: true where canonical is among hits. counts: how many rows that may be hits each URL has."""
    n, size = hits.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("canonical")), F.lit(0))).first()
    if n <= broadcast_rows and size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(hits), "canonical", "left")
    total = counts.agg(F.sum("n")).first()[0]
    hot = counts.where(F.col("n") > max(1, total // (4 * partitions(rows.sparkSession))))  # so few, whatever the total
    hot = hot.join(hits, "canonical", "left").select("canonical", F.coalesce("hit", F.lit(False)).alias("hit"))
    named = rows.join(F.broadcast(hot), "canonical", "left")
    settled = F.col("hit").isNotNull() | F.col("may").isNull() | ~F.col("may")
    rest = named.where(~settled).drop("hit").join(hits, "canonical", "left")
    return named.where(settled).unionByName(rest)
