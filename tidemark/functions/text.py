"""Text and URL expressions: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model: texts that mean missing, and query keys that only track visitors.
MISSING_TEXTS = ["<NA>", "nan", "None"]
TRACKING_KEYS = ["fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "ref_src"]
TRACKING_PREFIX = "utm_"

#: Groups: authority, path, query.
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)([^?#]*)(?:\?([^#]*))?"


BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.btrim(c.cast("string"), F.lit(BLANKS))


def clean_text(c: Column) -> Column:
    """Trimmed text; blank text and words for missing become null."""
    return F.when(~c.cast("string").isin(MISSING_TEXTS) & (strip(c) != ""), strip(c))


def text_key(c: Column) -> Column:
    """Cleaned, lower-cased, runs of white space as one space."""
    return F.regexp_replace(F.lower(clean_text(c)), r"\s+", " ")


def url_domain(c: Column) -> Column:
    """Lower-cased authority less a leading www.; port and user stay. Null without one."""
    host = F.regexp_replace(F.lower(F.trim(F.regexp_extract(c, _URL, 1))), r"^www\.", "")
    return F.nullif(host, F.lit(""))


def unquoted(c: Column, plus: bool = True) -> Column:
    """Percent-decoded text; where the escapes are bad, the text itself. plus: + stands for a space."""
    raw = F.regexp_replace(c, r"\+", " ") if plus else c
    return F.coalesce(F.try_url_decode(c if plus else F.regexp_replace(c, r"\+", "%2B")), raw)


def quoted(c: Column) -> Column:
    """Form encoding that leaves letters, digits, _ . - ~ and turns spaces to +."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(c), r"\*", "%2A"), "%7E", "~")


def canonical_url(c: Column) -> Column:
    """https, the domain, the path less a last /, and the sorted query without tracking keys and blank values; null without a domain."""
    url = clean_text(c)
    domain = url_domain(url)
    path = F.regexp_replace(strip(F.regexp_extract(url, _URL, 2)), r";[^/]*$", "")
    path = F.when(path == "", "/").when((path != "/") & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    pairs = F.transform(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda x: F.struct(
        F.lower(strip(unquoted(F.split_part(x, F.lit("="), F.lit(1))))).alias("k"),
        F.when(F.instr(x, "=") > 0, unquoted(F.regexp_replace(x, "^[^=]*=", ""))).alias("v"),
    ))
    kept = F.filter(pairs, lambda p: (p["k"] != "") & F.coalesce(p["v"] != "", F.lit(False)) & ~p["k"].isin(TRACKING_KEYS) & ~p["k"].startswith(TRACKING_PREFIX))
    query = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(quoted(p["k"]), F.lit("="), quoted(p["v"]))), "&")
    return F.when(domain.isNotNull(), F.concat(F.lit("https://"), domain, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def article_key(title: Column, url: Column, domain: Column, source: Column) -> Column:
    """What makes two articles the same: the canonical url, else domain and title, else source and title, else the title."""
    return F.coalesce(
        F.concat(F.lit("url::"), canonical_url(url)), F.concat(F.lit("domain_title::"), text_key(domain), F.lit("::"), text_key(title)),
        F.concat(F.lit("source_title::"), text_key(source), F.lit("::"), text_key(title)), F.concat(F.lit("title::"), text_key(title)),
    )


def market_url(c: Column) -> Column:
    """(kind, slug) of an event or market page; null for other paths."""
    path = F.regexp_extract(c, _URL, 2)
    kind = F.regexp_extract(path, "^/(event|market)/[^/]", 1)
    slug = unquoted(F.regexp_extract(path, "^/(?:event|market)/([^/]+)", 1), plus=False)
    return F.when((kind != "") & (F.regexp_extract(c, _URL, 1) != ""), F.struct(kind.alias("kind"), slug.alias("slug")))


def slug_variants(c: Column) -> Column:
    """The slug, and the slug less a last -digits where something is left."""
    return F.array_distinct(F.array(c, F.regexp_replace(c, r"(?<=.)-\d+$", "")))


def is_condition_id(c: Column) -> Column:
    return F.coalesce(c.startswith("0x") & (F.length(c) >= 10), F.lit(False))


def language_matches(actual: Column, expected: str) -> Column:
    """Equal after trimming and lower-casing; en, eng and english are one. Null matches nothing."""
    wanted = expected.strip().lower()
    found = F.lower(strip(actual))
    if wanted == "english":
        hit = found.isin("english", "en", "eng")
    elif wanted in ("en", "eng"):
        hit = found.isin(wanted, "english")
    else:
        hit = found == wanted
    return F.coalesce(hit, F.lit(False)) if wanted else F.lit(False)


def snake_case(name: str) -> str:
    """camelCase and kebab-case to snake_case."""
    import re

    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=.)(?=[A-Z][a-z])(?<!_)", "_", name).replace("-", "_").lower()
