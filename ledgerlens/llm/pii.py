"""Personal data and what reveals it, in DataFrame functions only.

Base spans are e-mail addresses, IP addresses, payment cards and phone
numbers by pattern. They are the protected entities. Terms (words of letters)
that stand near an entity are weighed by corpus co-occurrence: with c the
number of distinct contexts in which the term stands near this entity value,
n the number of its occurrences in the whole corpus, where copies of a text
with entities and copies of one of these contexts count once, the chance that
the term gives the entity away is at least c / n, and its disclosure is
log2(c N / (n m)) bits, N being all words of the corpus and m the words near
the entity. A term with at least ``SUPPORT`` contexts, ``BITS`` bits and a
chance of ``GENERALISE`` is generalised to ``[TERM]`` wherever it stands, from
a chance of ``REMOVE`` on it is removed. Copies of one context count once
as evidence, so a passage copied a thousand times reveals no more than one,
and no less.

The patterns are written so that Java's matcher neither recurses per
character nor rescans a run of characters from each of its positions; they
match what the plain ones match (see ``PLAIN``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

#: Base kinds in the order that breaks ties, as plain patterns.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same in a form that Java matches in linear time and constant stack: a
#: match starts at the start of a run or where the last match ended, and
#: repeated groups are one character wide.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]"
             r"(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:(?![\x20-](?![0-9]))[0-9\x20-])++",
    "phone": PLAIN["phone"],
}
#: A character that every match of a kind holds (texts without it are passed by).
HOLDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = [*PLAIN, "term"]
SUPPORT, BITS, GENERALISE, REMOVE = 3, 6.0, 0.5, 0.9
#: Code points of context on each side of an entity, and term lengths.
CONTEXT, TERM_MIN, TERM_MAX = 48, 3, 40
#: Candidate terms (and terms to mask) up to which a table is broadcast.
BROADCAST_TERMS = 50_000

SPAN = "struct<start:int,kind:int,end:int,value:string>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    digits = F.split(F.reverse(_digits(c)), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, F.try_to_number(d, F.lit("9")).cast("int"))
                          .otherwise(F.try_to_number(d, F.lit("9")).cast("int") * 2))
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when(n.between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _is_valid(kind: str):
    return lambda span: _valid(kind, span["value"])


def _of_kind(number: int):
    return lambda span: span["kind"] == number


def _placed(gaps: Column, hits: Column, kind: Column) -> Column:
    """Spans of matches from the texts between them and their own."""
    pieces = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), h.alias("h")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc, p):
        begin = acc["at"] + p["g"]
        end = begin + F.length(p["h"])
        span = F.struct(begin.alias("start"), kind.alias("kind"), end.alias("end"), p["h"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pieces, start, step, lambda acc: acc["spans"])


def with_base_spans(docs: DataFrame, column: str = "_base") -> DataFrame:
    """``docs`` with the valid base spans, by start and then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs
    for k, pattern in PATTERNS.items():
        may = F.contains(text, F.lit(HOLDS[k])) if HOLDS[k] else F.lit(True)
        none = F.array().cast("array<string>")
        out = out.withColumn(f"_{k}_hits", F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    for k, pattern in PATTERNS.items():
        # most texts have no match and need no second pass
        out = out.withColumn(f"_{k}_gaps", F.when(F.size(f"_{k}_hits") > 0, F.split(text, pattern, -1))
                             .otherwise(F.array().cast("array<string>")))
    spans = [F.filter(_placed(F.col(f"_{k}_gaps"), F.col(f"_{k}_hits"), F.lit(i)),
                      _is_valid(k)) for i, k in enumerate(PATTERNS)]
    return (out.withColumn(column, F.array_sort(F.concat(*spans)))
            .drop(*(f"_{k}_{x}" for k in PATTERNS for x in ("hits", "gaps"))))


def _terms(c: Column) -> Column:
    return F.split(F.lower(c), r"[^\p{L}]+")


def disclosing_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(term, chance, bits) of the terms over the thresholds.

    ``spans``: one row per document with ``text`` and ``_base``."""
    key = F.sha2("text", 256).alias("key")
    told = stage(spans.groupBy(key).agg(F.first("text").alias("text"), F.first("_base").alias("_base"),
                                        F.count(F.lit(1)).alias("times")), "told")
    near = told.select("key", "text", F.explode("_base").alias("s")).select(
        "key", F.concat_ws(":", "s.kind", F.lower("s.value")).alias("entity"), "s.start", "s.end",
        F.expr(f"substring(text, greatest(1, s.start + 1 - {CONTEXT}), least({CONTEXT}, s.start))").alias("before"),
        F.expr(f"substring(text, s.end + 1, {CONTEXT})").alias("after"),
        F.expr(f"s.start > {CONTEXT}").alias("cut_before"), F.expr(f"length(text) > s.end + {CONTEXT}").alias("cut_after"))
    # where contexts of one value overlap in a text, each place belongs to one
    place = Window.partitionBy("key", "entity").orderBy("start", "end")
    past = F.coalesce(F.lag("end").over(place) + CONTEXT, F.lit(0))
    near = (near.withColumn("own_before", F.greatest(F.lit(0), F.least(F.length("before"), F.col("start") - past)))
            .withColumn("own_after", F.least(F.length("after"), F.greatest(
                F.lit(0), F.coalesce(F.lead("start").over(place) - F.col("end"), F.length("after"))))))
    contexts = near.groupBy("entity", "before", "after").agg(
        F.count(F.lit(1)).alias("copies"), *(F.min(c).alias(c) for c in ("cut_before", "cut_after", "own_before", "own_after")))
    # words that the context's outer edge may have cut are left out
    first, last = (lambda c: F.regexp_replace(c, r"^\S*\s?", "")), (lambda c: F.regexp_replace(c, r"\s?\S*$", ""))
    own = F.concat(
        _terms(F.when(F.col("own_before") < F.length("before"), first(F.expr("right(before, own_before)")))
               .when(F.col("cut_before"), first(F.col("before"))).otherwise(F.col("before"))),
        _terms(F.when(F.col("own_after") < F.length("after"), F.expr("left(after, own_after)"))
               .when(F.col("cut_after"), last(F.col("after"))).otherwise(F.col("after"))))
    words = F.concat(_terms(F.when(F.col("cut_before"), first(F.col("before"))).otherwise(F.col("before"))),
                     _terms(F.when(F.col("cut_after"), last(F.col("after"))).otherwise(F.col("after"))))
    met = (contexts.select("entity", F.size(words).alias("size"), "copies", own.alias("own"),
                           F.explode(F.array_distinct(words)).alias("term"))
           .where(F.length("term").between(TERM_MIN, TERM_MAX))
           .withColumn("again", (F.col("copies") - 1) * F.size(F.filter("own", lambda w: w == F.col("term")))))
    pairs = met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("m"),
                                              F.sum("again").alias("again"))
    pairs = stage(pairs.where(F.col("c") >= SUPPORT), "term-pairs")
    terms = pairs.select("term").distinct()
    if pairs.isEmpty():
        return pairs.select("term", F.lit(0.0).alias("chance"), F.lit(0.0).alias("bits"))
    spoken = docs.select(F.explode(_terms(F.col("text"))).alias("term")).where("term <> ''")
    if terms.count() <= BROADCAST_TERMS:
        known = F.broadcast(terms.withColumnRenamed("term", "known"))
        counts = spoken.join(known, F.col("term") == F.col("known"), "left").groupBy("known").agg(F.count(F.lit(1)).alias("n"))
    else:
        all_counts = spoken.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        counts = (all_counts.join(terms.withColumnRenamed("term", "known"), F.col("term") == F.col("known"), "left")
                  .groupBy("known").agg(F.sum("n").alias("n")))
    counts = stage(counts, "term-counts")
    total = counts.agg(F.sum("n")).first()[0]
    whole = (told.where("times > 1").select((F.col("times") - 1).alias("more"), F.explode(_terms(F.col("text"))).alias("term"))
             .groupBy("term").agg(F.sum("more").alias("more")))
    n = F.greatest("c", F.col("n") - F.coalesce("more", F.lit(0)) - F.col("again"))
    rated = (pairs.join(counts.withColumnRenamed("known", "term"), "term").join(whole, "term", "left")
             .withColumn("n", n)).select(
        "term", (F.col("c") / F.col("n")).alias("chance"),
        F.log2(F.col("c") * F.lit(float(total)) / (F.col("n") * F.col("m"))).alias("bits"))
    rated = rated.where((F.col("chance") >= GENERALISE) & (F.col("bits") >= BITS))
    return rated.groupBy("term").agg(F.least(F.lit(1.0), F.max("chance")).alias("chance"), F.max("bits").alias("bits"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_spans`` (base and term spans by start,
    then kind; a term's value is ``[TERM]`` or empty, what replaces it)."""
    based = with_base_spans(docs)
    found = stage(based.where(F.size("_base") > 0).select("text", "_base"), "pii-spans")
    terms = stage(disclosing_terms(docs, found), "terms")
    n = terms.count()
    if n == 0:
        return based.withColumn("_spans", F.col("_base"))
    known = terms.select("term", F.when(F.col("chance") >= REMOVE, F.lit("")).otherwise(F.lit("[TERM]")).alias("as"))
    # the terms of each text, by its digest: equal texts have equal terms
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    spoken = docs.select(key.alias("_key"), F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    hit = (spoken.join(F.broadcast(known) if n <= BROADCAST_TERMS else known, "term")
           .groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("term", "as"))).alias("_terms")))
    joined = based.withColumn("_key", key).join(hit, "_key", "left").drop("_key")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.concat_ws("|", F.map_keys("_terms")), F.lit(r")(?!\p{L})"))
    joined = joined.withColumn("_pattern", F.when(F.col("_terms").isNotNull(), pattern))
    joined = (joined.withColumn("_hits", F.regexp_extract_all(F.col("text"), F.col("_pattern"), F.lit(0)))
              .withColumn("_gaps", F.split(F.col("text"), F.col("_pattern"), F.lit(-1))))
    added = F.transform(_placed(F.col("_gaps"), F.col("_hits"), F.lit(len(PLAIN))), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        F.coalesce(F.element_at(F.col("_terms"), F.lower(s["value"])), F.lit("[TERM]")).alias("value")))
    none = F.array().cast(f"array<{SPAN}>")
    return (joined.withColumn("_spans", F.array_sort(F.concat("_base", F.coalesce(added, none))))
            .drop("_terms", "_pattern", "_hits", "_gaps"))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """Per document: base counts by kind, digest of the base spans, and all
    spans as ``kind:start:end`` (code points, end exclusive)."""
    spanned = with_spans(docs.select("doc_id", "text"))
    counts = [F.size(F.filter("_base", _of_kind(i))).cast("bigint").alias(f"n_{k}")
              for i, k in enumerate(PLAIN)]
    return spanned.select("doc_id", *counts, F.sha2(_named(F.col("_base")), 256).alias("base_sha256"),
                          _named(F.col("_spans")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, each base span replaced by its kind in
    brackets and each term span generalised or removed; overlapping spans are
    replaced as one, by what stands for the first. ``n_chars``, where present,
    follows the text. A NULL text stays NULL."""
    spanned = with_spans(docs)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in PLAIN))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        word = F.when(s["kind"] == len(PLAIN), s["value"]).otherwise(F.element_at(names, F.least(s["kind"], F.lit(len(PLAIN) - 1)) + 1))
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], before, word).alias("out"))) \
            .otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    clean = F.aggregate("_spans", start, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    text = F.when(F.size("_spans") > 0, clean).otherwise(F.col("text"))
    out = spanned.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
