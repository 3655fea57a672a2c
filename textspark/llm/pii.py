"""Information-theoretic sanitisation in DataFrame functions only.

Personal data of four kinds, and opaque keys, are found by pattern. Each
distinct value is a protected entity. The corpus then tells which other terms reveal an entity:
over distinct contexts (``REACH`` words on either side of each mention, up to
the next match of its kind; equal contexts counted once, so copies add nothing)

    IC(e)    = -log(c(e) / C)                  information of the entity
    PMI(e,t) = log(c(e,t) * C / (c(e) * c(t))) what the term tells of it

with C the corpus size in contexts and c(t) the term's count over all words of
all documents. A term whose PMI reaches ``GENERALISE`` of the entity's
information, on at least ``SUPPORT`` contexts, is generalised to its class in
the documents that hold the entity; from ``REMOVE`` on it is removed.

Every pattern is written so that a scan is linear in the text: runs are
possessive and start only where a run starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BREAK_PATTERN, at_most, saved, sized

REACH = 8
SUPPORT = 2
GENERALISE = 0.8
REMOVE = 0.95
#: Terms whose counts are joined before the words are counted, and rows of spans or terms that may be broadcast.
TERMS = 200_000

KINDS = ("email", "ip", "card", "phone")
#: Further protected entities: opaque keys of 20 and more letters and digits, both in them.
KEY = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+"
#: Java patterns with the matches of the contract's patterns, leftmost and non-overlapping.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "key": KEY,
}
ALL = (*KINDS, "key")
#: What replaces a value or a term is no term itself.
NOT_A_MARK = r"(?!(?<=\[)(?:EMAIL|IP|CARD|PHONE|KEY|NUMBER|TERM)\])"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"\A(?:{OCTET}\.){{3}}{OCTET}\z")
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: Column | str) -> tuple[Column, Column]:
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.split(text, p, -1), F.regexp_extract_all(text, p, F.lit(0))


def matches(text: Column, pattern: Column | str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, in code points, end exclusive."""
    gaps, values = _pieces(text, pattern)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def placed(values: Column) -> Column:
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(values)), values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
        first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        return F.when(F.size(values) == 0, empty).otherwise(F.aggregate(pairs, first, add, lambda acc: acc["out"]))

    return F.transform(F.array(values), placed)[0]


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(F.contains(text, F.lit("@")), found).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")) if kind == "email" else found


def _told(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BREAK_PATTERN), lambda w: w != "")


def _term(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def _contexts(text: Column, kind: str) -> Column:
    """array<struct<entity, context, terms>> of the mentions of one kind; a context ends at the next match of the kind."""
    gaps, values = _pieces(text, PATTERNS[kind])

    def one(before: Column, value: Column, after: Column) -> Column:
        first, last = F.transform(F.array(_words(before)), lambda w: F.slice(w, F.greatest(F.lit(1), F.size(w) - REACH + 1), F.lit(REACH)))[0], F.slice(_words(after), 1, REACH)
        near = F.concat(first, last)
        terms = F.filter(F.array_distinct(F.transform(near, _term)), lambda t: F.length(t) > 0)
        name = F.lower(value) if kind in ("email", "ip") else value if kind == "key" else _digits(value)
        return F.struct(F.concat_ws(":", F.lit(kind), name).alias("entity"), F.xxhash64(near).alias("context"), terms.alias("terms"))

    def all_of(pieces: Column) -> Column:
        g, v = pieces["gaps"], pieces["values"]
        sides = F.zip_with(F.slice(g, F.lit(1), F.size(v)), F.slice(g, F.lit(2), F.size(v)), lambda x, y: F.struct(x.alias("before"), y.alias("after")))
        rows = F.zip_with(sides, v, lambda x, y: F.struct(x["before"].alias("before"), y.alias("value"), x["after"].alias("after")))
        return F.transform(F.filter(rows, lambda r: _valid(kind, r["value"])), lambda r: one(r["before"], r["value"], r["after"]))

    return F.transform(F.array(F.struct(gaps.alias("gaps"), values.alias("values"))), all_of)[0]


NO_CONTEXT = "array<struct<entity:string,context:bigint,terms:array<string>>>"


def _found(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), *[base_spans(text, k).alias(k) for k in ALL])
    contexts = F.concat(*[F.when(F.size(k) > 0, _contexts(F.col("text"), k)).otherwise(F.array().cast(NO_CONTEXT)) for k in ALL])
    return rows.select("doc_id", "text_hash", *ALL, contexts.alias("contexts"))


def disclosing_terms(documents: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame | None:
    """Rows (entity, term, share) of terms that reveal an entity; None where no term has the support."""
    seen = found.where("size(contexts) > 0").select(F.explode("contexts").alias("x")).select("x.*").dropDuplicates(["entity", "context"])
    entities = seen.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= support)
    pairs = seen.join(entities, "entity").select("entity", "n_entity", F.explode("terms").alias("term")).groupBy("entity", "n_entity", "term").agg(F.count("*").alias("n_both"))
    pairs = saved(pairs.where(F.col("n_both") >= support), "pairs")
    if at_most(pairs, 0):
        return None
    words = documents.select(_words(F.coalesce("text", F.lit(""))).alias("words"))
    total = words.agg(F.sum(F.size("words").cast("long"))).first()[0]
    wanted = saved(pairs.select("term").distinct(), "terms")
    terms = words.select(F.explode("words").alias("word")).select(_term(F.col("word")).alias("term"))
    few = at_most(wanted, TERMS)
    counts = (terms.join(F.broadcast(wanted), "term") if few else terms).groupBy("term").agg(F.count("*").alias("n_term"))
    size = F.lit(max(1.0, total / (2 * REACH)))
    pmi = F.log(F.col("n_both") * size / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    information = F.log(size / F.col("n_entity"))
    share = F.when(information > 0, pmi / information)
    return saved(pairs.join(counts, "term").select("entity", "term", share.alias("share")).where(F.col("share") >= generalise), "disclosing")


def _term_pattern(terms: Column) -> Column:
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(terms, lambda t: F.concat(F.lit("\\Q"), F.replace(t, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "|"), F.lit(r")(?![\p{L}\p{N}])"))


def _document_terms(found: DataFrame, disclosing: DataFrame) -> DataFrame:
    """Per document (doc_id, text_hash): the terms that reveal one of its entities, and those to remove."""
    held = found.where("size(contexts) > 0").select("doc_id", "text_hash", F.explode(F.array_distinct(F.transform("contexts", lambda x: x["entity"]))).alias("entity"))
    shares = held.join(sized(disclosing, TERMS), "entity").groupBy("doc_id", "text_hash", "term").agg(F.max("share").alias("share"))
    return shares.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list("term")).alias("terms"), F.array_sort(F.collect_list(F.when(F.col("share") >= REMOVE, F.col("term")))).alias("removed"))


def find_spans(documents: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """One row for each row of ``documents``: doc_id, counts and spans (base kinds, then keys, then terms).

    Null texts count as empty. Rows may repeat; a repeated row gets the same
    spans. A null doc_id keeps its base spans and gets no term spans. Other
    columns are not read; an empty table gives an empty result.
    """
    found = saved(_found(documents), "found")
    disclosing = disclosing_terms(documents, found, support, generalise)
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    if disclosing is None:
        rows = found.withColumn("term", none)
    else:
        text = F.coalesce("text", F.lit(""))
        per = _document_terms(found, disclosing)
        spans = documents.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).join(sized(saved(per, "document_terms"), TERMS), ["doc_id", "text_hash"])
        spans = spans.select("doc_id", "text_hash", matches(F.col("text"), _term_pattern(F.col("terms"))).alias("term")).dropDuplicates(["doc_id", "text_hash"])
        rows = found.join(sized(saved(spans, "term_spans"), TERMS), ["doc_id", "text_hash"], "left").withColumn("term", F.coalesce("term", none))
    base = F.concat(*[_told(k, F.col(k)) for k in KINDS])
    more = F.concat(_told("key", F.col("key")), _told("term", F.col("term")))
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in ("key", "term")],
        sum((F.size(k) for k in (*ALL, "term")), F.lit(0)).cast("long").alias("n_spans"),
    )


def _replaced(text: Column, kind: str) -> Column:
    """``text`` with the valid matches of a kind replaced by its name in brackets."""
    gaps, values = _pieces(text, PATTERNS[kind])

    def put(values: Column) -> Column:
        shown = F.transform(values, lambda v: F.when(_valid(kind, v), F.lit(f"[{kind.upper()}]")).otherwise(v))
        joined = F.array_join(F.zip_with(gaps, F.concat(shown, F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
        return F.when(F.size(values) == 0, text).otherwise(joined)

    return F.transform(F.array(values), put)[0]


def sanitised(documents: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``documents`` with personal data replaced and disclosing terms generalised or removed.

    Kinds are replaced in their order and before the terms, which are looked
    for only in what is left, so that no term breaks up a value. Terms become
    [NUMBER] or [TERM]; those of share ``REMOVE`` and more go. A null text
    stays null; ``n_chars``, where there is one, follows the text.
    """
    found = saved(_found(documents), "found")
    disclosing = disclosing_terms(documents, found, support, generalise)
    rows = documents
    if disclosing is not None:
        per = saved(_document_terms(found, disclosing), "document_terms").withColumnsRenamed({"doc_id": "_doc_id", "text_hash": "_text_hash", "terms": "_terms", "removed": "_removed"})
        key = F.xxhash64(F.coalesce("text", F.lit("")))
        rows = documents.join(sized(per, TERMS), (F.col("doc_id") == F.col("_doc_id")) & (key == F.col("_text_hash")), "left")
    for kind in ALL:
        rows = rows.withColumn("text", _replaced(F.col("text"), kind))
    if disclosing is not None:
        text, kept = F.col("text"), F.array_except("_terms", "_removed")
        numbers = F.filter(kept, lambda t: t.rlike(r"\A[0-9]+\z"))
        for terms, to in ((F.col("_removed"), ""), (numbers, "[NUMBER]"), (F.array_except(kept, numbers), "[TERM]")):
            text = F.when(F.size(terms) > 0, F.regexp_replace(text, F.concat(F.lit(NOT_A_MARK), _term_pattern(terms)), F.lit(to))).otherwise(text)
        rows = rows.withColumn("text", text)
    if "n_chars" in documents.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*documents.columns)
