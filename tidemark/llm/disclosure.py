"""Personal data in texts, and the terms beside it that disclose it.

Emails, IP addresses, card and phone numbers are found by patterns. How strongly a term t reveals such an entity e follows
from the whole corpus, with counts by distinct texts: the share p(e | t) of the term's texts that hold the entity, at its
lower confidence bound, so that few texts show less than many. -log2 of it are the bits that are left to find the entity
by once the term is known, which doesn't change with the size of the corpus. Evidence is asked for: the two stand together
in several texts, and in more than chance would bring, with a correction for all pairs that were tried. In the texts that
hold the entity, terms at the threshold or over are generalised wherever they stand: to what kind of word they are. Those
over a second threshold are removed.

All of it is DataFrame and SQL expressions. Matches and words are rows, their places running sums over a text's rows,
and what they touch is told by their neighbours in order, so the work grows with a text's length, not its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import beside, rejoined
from .shared import cut

#: The contract's patterns, with possessive repeats and look-behinds that keep the search linear; they match the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text needs to hold at all for a pattern to match.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A word of letters that is no part of a longer token of letters, digits and marks of words.
WORD = r"(?<![\p{L}\p{M}\p{N}_])\p{L}{3,}+(?![\p{M}\p{N}_])"
#: The least share that a pair needs besides chance: distinct texts of both, and the probability of as many by chance.
LEAST_TEXTS, CHANCE = 2, 0.01
#: Code points that are cut from a long text at once.
BLOCK = 1_000


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check; the array is read from the right."""

    def value(digit: Column, place: Column) -> Column:
        d = digit.cast("int")
        return F.when(place % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda total, v: total + v) % 10 == 0


def _octet(part: Column) -> Column:
    return F.coalesce(F.regexp_replace(part, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, "[.]"), _octet),
    "card": lambda m: F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
ENTITY = {"email": F.lower, "ip": lambda m: m, "card": _digits, "phone": _digits}
PIECES = "array<struct<no:int,at:int,before:int,long:int,m:string>>"


def _pieces(no: int, pattern: str, found: Column) -> Column:
    """An array of (no, at, before, long, m) of all matches: their lengths and those of what stands before each, in code points."""
    before = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(found))
    each = F.transform(F.zip_with(before, found, lambda b, m: F.struct(F.length(b).alias("before"), m.alias("m"))), lambda x, at: F.struct(
        F.lit(no).alias("no"), at.alias("at"), x["before"].alias("before"), F.length(x["m"]).alias("long"), x["m"].alias("m"),
    ))
    return F.when(F.size(found) > 0, each).otherwise(F.array()).cast(PIECES)


def _placed(pieces: DataFrame) -> DataFrame:
    """h, no, start, end, m from rows (h, no, at, before, long, m): running sums in the order of at."""
    end = F.sum(F.col("before") + F.col("long")).over(Window.partitionBy("h", "no").orderBy("at")).cast("int")
    return pieces.select("h", "no", end.alias("end"), "long", "m").select("h", "no", (F.col("end") - F.col("long")).alias("start"), "end", "m")


def with_matches(df: DataFrame) -> DataFrame:
    """Adds found: the pieces of all matches of the patterns in the column text, valid or not."""
    every = {}
    for kind, pattern in PATTERNS.items():
        some = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        every[f"found_{kind}"] = F.when(F.col("text").contains(HINTS[kind]), some).otherwise(F.array().cast("array<string>"))
    parts = [_pieces(no, pattern, F.col(f"found_{kind}")) for no, (kind, pattern) in enumerate(PATTERNS.items())]
    return df.withColumns(every).withColumn("found", F.concat(*parts)).drop(*every)


def base_spans(found: DataFrame) -> DataFrame:
    """h, no, start, end, entity of every valid match, from (h, found), one row a text."""
    every = _placed(found.select("h", F.explode("found").alias("x")).select("h", "x.*"))
    valid, entity = F.lit(False), F.lit(None).cast("string")
    for no, kind in enumerate(PATTERNS):
        valid = F.when(F.col("no") == no, VALID[kind](F.col("m"))).otherwise(valid)
        entity = F.when(F.col("no") == no, F.concat(F.lit(kind + ":"), ENTITY[kind](F.col("m")))).otherwise(entity)
    return every.where(valid).select("h", "no", "start", "end", entity.alias("entity"))


def words_outside(texts: DataFrame, base: DataFrame) -> DataFrame:
    """h, term, general (what kind of word it is), start, end of every word of (h, text), one row a text, that neither overlaps nor touches a base span.

    In order of start, a span that reaches a word begins before it and ends last of those, or is the next to begin.
    """
    found = _pieces(0, WORD, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    words = _placed(texts.select("h", F.explode(found).alias("x")).select("h", "x.*"))
    none = F.lit(None).cast("string")
    both = words.select("h", "start", "end", F.lower("m").alias("term"), category(F.col("m")).alias("general")).unionByName(base.select("h", "start", "end", none.alias("term"), none.alias("general")))
    is_span = F.col("term").isNull()
    up, down = Window.partitionBy("h").orderBy("start", F.col("term").asc_nulls_first()), Window.partitionBy("h").orderBy(F.col("start").desc())
    reached = F.max(F.when(is_span, F.col("end"))).over(up.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(is_span, F.col("start"))).over(down.rowsBetween(Window.unboundedPreceding, 0))
    free = F.coalesce(F.col("reached") < F.col("start"), F.lit(True)) & F.coalesce(F.col("ahead") > F.col("end"), F.lit(True))
    return both.withColumns({"reached": reached, "ahead": ahead}).where(F.col("term").isNotNull() & free).select("h", "term", "general", "start", "end")


def lower_bound(both: Column, of: Column, z: float) -> Column:
    """Wilson's lower confidence bound of the share both / of."""
    share, zz = both / of, z * z
    return (share + zz / (2 * of) - z * F.sqrt(share * (1 - share) / of + zz / (4 * of * of))) / (1 + zz / of)


def category(word: Column) -> Column:
    """What a word is generalised to: a name if it is capitalised, an abbreviation if it is all in capitals, else a term."""
    first, rest = F.substring(word, 1, 1), F.substring(word, 2, 2**31 - 1)
    upper = (first == F.upper(first)) & (first != F.lower(first))
    return F.when(upper & (word == F.upper(word)), "[ABBREVIATION]").when(upper & (rest == F.lower(rest)), "[NAME]").otherwise("[TERM]")


def above_chance(both: Column, with_term: Column, with_entity: Column, total: int, tried: int, chance: float) -> Column:
    """Whether so many common texts are improbable for a term and an entity that have nothing to do with each other.

    By Chernoff's bound on the tail of a count around its expectation, times the number of pairs tried.
    """
    expected = with_term.cast("double") * with_entity / total
    log_p = both - expected - both * F.log(both / expected)
    return (both > expected) & (log_p + F.log(F.lit(float(max(1, tried)))) <= F.log(F.lit(chance)))


def sanitise(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", z: float = 1.2816,
    generalise_at: float = 0.5, remove_at: float = 0.75, with_text: bool = False, least_texts: int = LEAST_TEXTS, chance: float = CHANCE,
) -> DataFrame:
    """Spans of personal data and of terms that disclose it.

    A term is a word of three letters or more, lower-cased, that is no part of a longer token and neither overlaps nor
    touches a base span. Of all distinct texts with the term anywhere, the share of those that hold the entity and have the
    term outside base spans is taken at Wilson's lower bound for z (one-sided 90 % by default): the disclosure. Every
    occurrence in the texts that hold the entity joins the spans, as kind term, where the disclosure is generalise_at (one
    bit left) or more, at least least_texts distinct texts hold both, and so many would come by chance with a probability of
    at most chance, corrected for all pairs of entities and terms that were tried (those alike count once). Copies of a text
    count once.

    Returns one row per input row: the id column, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of
    kind:start:end of base spans, by start, then kind, comma-joined; code points, end exclusive), spans (all, joined
    likewise), n_term and, with_text, clean_text: base spans become [EMAIL] and so on. Terms go from remove_at on; under it
    they become [NAME], [ABBREVIATION] or [TERM], by their capitals.

    Null text counts as empty (clean_text stays null). Null ids and repeated ids: each row is judged by its own text.
    Other columns are neither read nor kept. An empty table gives an empty table.
    """
    sides, spans = _spans_of(docs.select(F.col(id_col).cast("long").alias("row"), F.col(text_col).cast("string").alias("given")), with_text, z, generalise_at, least_texts, chance)
    columns = [*[f"n_{k}" for k in PATTERNS], "base_sha256", "spans", "n_term", *(["clean_text"] if with_text else [])]
    return _beside(sides, spans, remove_at if with_text else None).select(F.col("row").alias(id_col), *columns)


def _spans_of(docs: DataFrame, with_given: bool, z: float = 1.2816, generalise_at: float = 0.5, least_texts: int = LEAST_TEXTS, chance: float = CHANCE) -> tuple[DataFrame, DataFrame]:
    """docs: (row, given) of any row. Returns row, h (a hash of the text), held (whether a pattern matches, valid or not),
    text (where one does) and, with_given, given; and for each text with spans h, the columns of sanitise, and every: its spans in order.
    """
    docs = docs.withColumn("text", F.coalesce("given", F.lit("")))
    docs = docs.withColumn("h", F.xxhash64("text"))
    found = with_matches(docs).withColumn("held", F.size("found") > 0)
    held = [F.when(F.col("held"), F.col(c)).alias(c) for c in ("text", "found")]
    found = cut(found.select("row", "h", "held", *held, *(["given"] if with_given else [])), "matches")
    total = found.select("h").distinct().count()
    once = found.where("held").dropDuplicates(["h"])
    base = cut(base_spans(once), "base")
    holders = base.select("h").distinct()
    words = cut(words_outside(once.select("h", "text").join(holders, "h", "left_semi"), base), "words")

    # Counts by distinct texts; each task sums its own terms before the shuffle.
    terms = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), F.lower))
    by_term = docs.select("h", "text").dropDuplicates(["h"]).select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    by_term = cut(by_term, "terms")
    # Entities that stand in the same texts are told by the same terms alike, and terms alike tell the same: a text's
    # classes are paired, not its entities and terms, which can be thousands each.
    alike = [F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"set{k}") for k in range(2)]
    holding = base.select("h", "entity").distinct()
    entities = holding.groupBy("entity").agg(F.count("*").alias("with_entity"), *alike).withColumn("entities", F.xxhash64("with_entity", "set0", "set1")).where(F.col("with_entity") >= least_texts)
    holding = holding.join(entities.select("entity", "entities", "with_entity"), "entity").select("h", "entities", "with_entity").distinct()
    told = words.select("h", "term").distinct()
    classed = told.groupBy("term").agg(F.count("*").alias("beside"), *alike).where(F.col("beside") >= least_texts).join(by_term, "term").withColumn("terms", F.xxhash64("beside", "set0", "set1", "with_term"))
    told = cut(told.join(classed.select("term", "terms", "with_term"), "term"), "told")

    # A term in too many texts can't reach the threshold even if every text of the entity has it.
    most = F.col("with_entity") / generalise_at
    pairs = cut(told.select("h", "terms", "with_term").distinct().join(holding, "h").where(F.col("with_term") <= most), "pairs")
    known = pairs.groupBy("entities", "terms").agg(F.count("*").alias("both"), F.first("with_term").alias("with_term"), F.first("with_entity").alias("with_entity"))
    known = cut(known.withColumn("disclosure", lower_bound(F.col("both"), F.col("with_term"), z)), "tried")
    shown = above_chance(F.col("both"), F.col("with_term"), F.col("with_entity"), total, known.count(), chance)
    known = known.where((F.col("both") >= least_texts) & (F.col("disclosure") >= generalise_at) & shown).select("entities", "terms", "disclosure")

    hits = pairs.join(known, ["entities", "terms"]).groupBy("h", "terms").agg(F.max("disclosure").alias("disclosure"))
    hits = told.select("h", "term", "terms").join(hits, ["h", "terms"]).join(words, ["h", "term"])
    hits = hits.select("h", F.lit(len(PATTERNS)).alias("no"), F.lit("term").alias("kind"), "start", "end", "disclosure", F.col("general").alias("put"))
    kind = F.element_at(F.array(*[F.lit(k) for k in PATTERNS]), F.col("no") + 1)
    spans = base.select("h", "no", kind.alias("kind"), "start", "end", F.lit(0.0).alias("disclosure"), F.concat(F.lit("["), F.upper(kind), F.lit("]")).alias("put")).unionByName(hits)

    # What an earlier span reaches over begins inside it and goes with it.
    before = F.max("end").over(Window.partitionBy("h").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("done", F.coalesce(before, F.lit(0)))
    every = spans.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("start", "no", "end", "kind", "done", "disclosure", "put"))).alias("every"))
    joined = F.expr("array_join(transform(every, x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    based = F.expr("array_join(transform(filter(every, x -> x.kind <> 'term'), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")
    counts = [F.expr(f"cast(size(filter(every, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in [*PATTERNS, "term"]]
    spans = cut(every.select("h", *counts, F.sha2(based, 256).alias("base_sha256"), joined.alias("spans"), "every"), "spans")
    return found.drop("found"), spans


def _beside(sides: DataFrame, spans: DataFrame, remove_at: float | None) -> DataFrame:
    """sides with the columns of spans and, unless remove_at is None, clean_text. Only rows that a pattern matches are joined."""
    none = {**{f"n_{k}": F.lit(0).cast("long") for k in [*PATTERNS, "term"]}, "spans": F.lit(""), "base_sha256": F.sha2(F.lit(""), 256)}
    found, rest = sides.where("held").join(spans, "h", "left"), sides.where("NOT held").withColumns(none)
    found = found.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    if remove_at is not None:
        blocks = F.when(F.col("every").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
        found = found.withColumn("blocks", blocks).withColumn("clean_text", F.when(F.col("every").isNull(), F.col("given")).otherwise(_replaced(remove_at)))
        rest = rest.withColumn("clean_text", F.col("given"))
    columns = ["row", *none, *(["clean_text"] if remove_at is not None else [])]
    return found.select(columns).unionByName(rest.select(columns))


def clean_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = 0.75, **limits: float) -> DataFrame:
    """The rows and columns of docs, their texts as sanitise cleans them; n_chars, if there, follows the text.

    Each row is judged by its own text, whatever its id; id_col is not read. Null texts stay null, and equal rows stay as
    many as they are. Columns may have any names. An empty table gives an empty table.
    """
    sides, spans = _spans_of(beside(docs, text_col).withColumnRenamed("text", "given"), True, **limits)
    return rejoined(docs, text_col, _beside(sides, spans, remove_at), "clean_text")


def _between(start: Column, end: Column) -> Column:
    """The text from start to end, from the column blocks; a cut looks at no more than the blocks it needs."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get("blocks", k), F.lit(""))
    head, tail = F.substring(block(first), start % BLOCK + 1, F.lit(BLOCK)), F.substring(block(last), F.lit(1), end % BLOCK)
    middle = F.array_join(F.slice("blocks", first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substring(block(first), start % BLOCK + 1, end - start)).otherwise(F.concat(head, middle, tail))


def _replaced(remove_at: float) -> Column:
    """The text with its spans replaced, from the columns blocks and every; a span that begins within an earlier one goes with that."""

    def piece(x: Column) -> Column:
        return F.concat(_between(x["done"], x["start"]), F.when((x["kind"] == "term") & (x["disclosure"] >= remove_at), "").otherwise(x["put"]))

    done = F.array_max(F.transform("every", lambda x: x["end"]))
    return F.concat(F.array_join(F.transform(F.filter("every", lambda x: x["start"] >= x["done"]), piece), ""), _between(done, F.length("text")))
