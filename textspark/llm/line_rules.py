"""Quality rules with cross-document line frequency, in DataFrame functions only.

Rules of a single text come first. Then lines are normalised and hashed, and
for each host the distinct documents of each line are counted; documents of
equal text are one document. Lines above a fixed count or above a share of the
host are boilerplate and are removed; a document of which too little remains
is rejected.

Texts are never shuffled: what is moved is one row for each distinct (host,
line) of a task, and one row for each distinct text. Counts are summed before
the shuffle, so a host or line with a third of all rows is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BREAK_PATTERN, WORD_BREAKS, saved, sized

#: Fewest words, and the largest share of words in repeated windows (percent), of the base rules.
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is boilerplate in a host if it is in more distinct documents than this, whatever the host's size,
LINE_DOCS = 50
#: or in more than this share of the host's distinct documents and in more than so many.
LINE_SHARE = 0.02
LINE_FLOOR = 5
#: A document is depleted with fewer words left, or with a smaller share of its words.
LEFT_WORDS = 10
LEFT_SHARE = 0.3


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BREAK_PATTERN), lambda w: w != "")


def _removed_length(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WORD_BREAKS, "") != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def repeat_words(words: Column) -> Column:
    """Words in 5-word windows that the text has twice or more, the first included."""

    def count(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(F.slice(w, i, F.lit(5))))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))

    def covered(g: Column) -> Column:
        placed = F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def at(s: Column) -> Column:
            same = F.zip_with(F.slice(s, F.lit(1), F.size(s) - 1), F.slice(s, F.lit(2), F.size(s)), lambda a, b: a["h"] == b["h"])
            return let(same, lambda e: F.array_sort(F.filter(
                F.zip_with(s, F.zip_with(F.concat(F.array(F.lit(False)), e), F.concat(e, F.array(F.lit(False))), lambda a, b: a | b), lambda x, on: F.when(on, x["i"])),
                lambda x: x.isNotNull())))

        def total(p: Column) -> Column:
            steps = F.zip_with(p, F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(F.lit(1 << 30))), lambda a, b: F.least(b - a, F.lit(5)))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(placed, at), total)

    return let(words, lambda w: F.when(F.size(w) < 6, F.lit(0)).otherwise(count(w)))


def normal_lines(text: Column) -> Column:
    """array<struct<line, words>>: hash and word count of each line with words, lower-cased, white space as one space, digits as 0."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " ")
    lines = F.filter(F.transform(F.split(low, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words")))


def common_lines(texts: DataFrame, line_docs: int, line_share: float, line_floor: int) -> DataFrame:
    """Rows (host, line, docs, most) of lines above the count or the share; ``most`` is the lower of the two limits, ``texts`` one row a distinct text."""
    share = F.greatest(F.lit(float(line_floor)), F.count("*") * line_share)
    limits = texts.groupBy("host").agg(F.least(F.lit(float(line_docs)), share).alias("most"))
    seen = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    return seen.where(F.col("docs") > min(line_docs, line_floor)).join(sized(limits, 100_000), "host").where("docs > most")


def apply_rules(documents: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR) -> DataFrame:
    """One row for each row: doc_id, the counts, base_failed and kept.

    Null texts count as empty (and fail). A null host is a host of its own.
    Rows that repeat, also under one doc_id, are judged each by its text and
    host. Other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    # Texts are told apart by two hashes of 64 bits and their length.
    key = {"host": F.coalesce(F.col(host).cast("string"), F.lit("\0null")), "text_a": F.xxhash64(text), "text_b": F.xxhash64(F.lit(1), text)}
    counted = documents.select(
        "doc_id", *[c.alias(k) for k, c in key.items()], F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"),
        F.length(F.translate(text, WORD_BREAKS, "")).cast("long").alias("word_chars"), _removed_length(text, "[#*$%&|<>]"[1:-1]).cast("long").alias("n_symbols"),
        dup_lines(text).cast("long").alias("n_dup_lines"), repeat_words(words_of(text)).cast("long").alias("n_repeat_words"),
    )
    counted = saved(counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))), "counted")
    texts = saved(documents.select(*[c.alias(k) for k, c in key.items()], normal_lines(text).alias("lines")).groupBy(*key).agg(F.first("lines").alias("lines")), "texts")
    common = saved(common_lines(texts, line_docs, line_share, line_floor).select("host", "line"), "common_lines")
    held = texts.select(*key, F.explode("lines").alias("x")).select(*key, "x.line", "x.words").join(sized(common, 500_000), ["host", "line"])
    gone = saved(held.groupBy(*key).agg(F.sum("words").alias("gone_words")), "gone_words")
    rows = counted.join(sized(gone, 500_000), list(key), "left")
    left = F.col("n_words") - F.coalesce("gone_words", F.lit(0))
    depleted = (F.coalesce("gone_words", F.lit(0)) > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~depleted).alias("kept"), left.alias("n_words_left"))


def cleaned(documents: DataFrame, host: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, line_floor: int = LINE_FLOOR) -> DataFrame:
    """Rows (host, line) are removed from the texts of ``documents``; all rows stay, see ``apply_rules`` for the verdict."""
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col(host).cast("string"), F.lit("\0null"))
    texts = documents.select(name.alias("host"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), normal_lines(text).alias("lines")).groupBy("host", "a", "b").agg(F.first("lines").alias("lines"))
    seen = common_lines(texts, line_docs, line_share, line_floor)
    held = texts.select("host", "a", "b", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).join(seen, ["host", "line"])
    per = held.groupBy("host", "a", "b").agg(F.collect_set("line").alias("_gone"))
    rows = documents.withColumns({"_host": name, "_a": F.xxhash64(text), "_b": F.xxhash64(F.lit(1), text)}).join(per.toDF("_host", "_a", "_b", "_gone"), ["_host", "_a", "_b"], "left")

    def stays(x: Column) -> Column:
        low = F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "[0-9]+", "0"), r"[\x20\x09\x0B-\x0D]+", " "))
        return ~F.array_contains("_gone", F.xxhash64(low))

    new = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), stays), "\n"))
    return rows.withColumn("text", new).select(*documents.columns)
