"""Quality by hierarchical empirical Bayes.

A logistic regression on statistics of the text gives each document a chance
of good quality. Labels then tell how far a site departs from what its texts
let expect: sums of the labels and of the chances of the labelled documents, by
host and by path in a host (grouped aggregation), give a rate and an expected
rate with two levels of shrinkage, paths to their host, hosts to the corpus.
The strength of each prior comes from the spread between sites by moments. The
odds of the rate over those of the expected rate multiply the document's odds:
text evidence is in both and counts once. A labelled document's own label and
chance are left out of its site's sums.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import fit_dense, labelled_sample, sigmoid
from .common import focus, saved, sized

#: Most labelled rows that the model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.5
#: Standard deviations from the mean beyond which a statistic is taken to lie there, when fitting and scoring.
REACH = 8.0
#: Sites whose sums may be broadcast (64 bytes each).
SITES = 100_000
STATISTICS = 14
SYMBOLS = re.compile(r"[#*$%&|<>~^=\\{}@]")


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; those of no words are zeros."""
    words = text.split() if text else []
    if not words:
        return np.zeros(STATISTICS)
    n, size = len(words), len(text)
    counts = Counter(words)
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text))
    lines = [x for x in text.split("\n") if x.strip()]
    return np.array([
        math.log(n),
        len(SYMBOLS.findall(text)) / n,
        text.count("!") / n,
        text.count("|") / n,
        upper / letters,
        letters / size,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(c for c in counts.values() if c > 1) / n,
        sum(map(str.isdigit, text)) / size,
        sum(map(len, words)) / n,
        1 - len(set(lines)) / len(lines),
        math.log(n / len(lines)),
        sum(w[-1] in ".,;:?" for w in words) / n,
    ])


def _stats(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([statistics(t).tobytes() for t in b.column(0).to_pylist()], pa.binary()), b.column(1)], ["x", "label"])


class Model:
    def __init__(self, x: np.ndarray | None = None, y: np.ndarray | None = None):
        self.low, self.high = np.full(STATISTICS, -np.inf), np.full(STATISTICS, np.inf)
        self.fitted = np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(STATISTICS), 3.0
        if x is not None and len(x):
            mean, scale = x.mean(0), x.std(0)
            self.low, self.high = mean - REACH * scale, mean + REACH * scale
            self.fitted = fit_dense(np.clip(x, self.low, self.high), y)

    def chance(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w, b = self.fitted
        return sigmoid((np.clip(x, self.low, self.high) - mean) / scale @ w + b)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents. Without labels every text has a chance of 0.95; with one label only, near it."""
    chosen = labelled_sample(labels, "quality", sample)
    rows = documents.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label").mapInArrow(_stats, "x binary, label int").distinct().orderBy(F.xxhash64("x"), "label").limit(sample).collect()  # repeated rows count once
    rows = sorted((bytes(r.x), r.label) for r in rows)
    return Model(np.array([np.frombuffer(x) for x, _ in rows]), np.array([y for _, y in rows], float))


def _chances(model: Model):
    def run(batches):
        focus("quality")
        for b in batches:
            x = np.array([statistics(t) for t in b.column(3).to_pylist()]).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *b.columns[4:], pa.array(model.value.chance(x))], [*b.schema.names[:3], *b.schema.names[4:], "p_text"])

    return run


def chances(documents: DataFrame, host: str, path: str, model: Model) -> DataFrame:
    """doc_id, host, path, text_hash, p_text (the chance of good quality by the text alone) of every row; null hosts and paths are one site each."""
    site = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select("doc_id", site(host).alias("host"), site(path).alias("path"), "text", F.xxhash64("text").alias("text_hash"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_chances(documents.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, host string, path string, text_hash long, p_text double")


def _strength(rate: Column, n: Column, mean: Column) -> Column:
    """Prior rows by moments: spread between sites beyond what their sizes explain."""
    spread = F.sum(n * (rate - mean) * (rate - mean)) / F.sum(n)
    within = F.avg(mean * (1 - mean)) * F.count("*") / F.sum(n)
    between = F.greatest(spread - within, F.lit(1e-6))
    return F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1e6), F.avg(mean * (1 - mean)) / between - 1)), F.lit(1e6))


class Prior:
    """The corpus rate of the labels and the strengths, in rows, of the priors of hosts and paths."""

    def __init__(self, corpus: float, host: float, path: float):
        self.corpus, self.host, self.path = corpus, host, path


def site_sums(scored: DataFrame) -> tuple[DataFrame, Prior]:
    """(host, path, y, e, n and the host's hy, he, hn): labels, chances and rows of the labelled; and the priors.

    ``scored`` has host, path, p_text and label (null if there is none).
    """
    paths = saved(scored.where("label is not null").groupBy("host", "path").agg(F.sum("label").cast("double").alias("y"), F.sum("p_text").alias("e"), F.count("*").alias("n")), "paths")
    hosts = saved(paths.groupBy("host").agg(F.sum("y").alias("hy"), F.sum("e").alias("he"), F.sum("n").alias("hn")), "hosts")
    y, n = hosts.agg(F.coalesce(F.sum("hy"), F.lit(0.0)), F.coalesce(F.sum("hn"), F.lit(0))).first()
    corpus = (y + 0.5) / (n + 1)
    k_host = hosts.agg(_strength(F.col("hy") / F.col("hn"), F.col("hn"), F.lit(corpus))).first()[0]
    sums = paths.join(sized(hosts, SITES), "host")
    host_rate = (F.col("hy") + k_host * corpus) / (F.col("hn") + k_host)
    k_path = sums.agg(_strength(F.col("y") / F.col("n"), F.col("n"), host_rate)).first()[0]
    return sums, Prior(corpus, k_host, k_path)


def _odds(p: Column) -> Column:
    return F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9))


def with_sites(scored: DataFrame) -> DataFrame:
    """``scored`` with host_rate, path_rate, path_expected and score, from sums without the row itself."""
    sums, prior = site_sums(scored)
    own = lambda c: F.coalesce(c, F.lit(0.0))
    label, chance = own(F.col("label").cast("double")), own(F.when(F.col("label").isNotNull(), F.col("p_text")))
    one = F.when(F.col("label").isNotNull(), 1.0).otherwise(0.0)
    rate = lambda total, out, n, k, mean: (own(F.col(total)) - out + k * mean) / (own(F.col(n).cast("double")) - one + k)
    rows = scored.join(sized(sums, SITES), ["host", "path"], "left")
    hosts = sums.groupBy("host").agg(F.first("hy").alias("_hy"), F.first("he").alias("_he"), F.first("hn").alias("_hn"))
    rows = rows.join(sized(hosts, SITES), "host", "left")  # paths without a label have their host's
    rows = rows.withColumns({"host_rate": rate("_hy", label, "_hn", prior.host, prior.corpus), "host_expected": rate("_he", chance, "_hn", prior.host, prior.corpus)})
    rows = rows.withColumns({"path_rate": rate("y", label, "n", prior.path, F.col("host_rate")), "path_expected": rate("e", chance, "n", prior.path, F.col("host_expected"))})
    odds = _odds(F.col("p_text")) * _odds(F.col("path_rate")) / _odds(F.col("path_expected"))
    return rows.withColumn("score", odds / (1 + odds)).withColumn("kept", F.col("score") >= THRESHOLD).select(*scored.columns, "host_rate", "path_rate", "path_expected", "score", "kept")


def _judged(documents: DataFrame, labels: DataFrame, host: str, path: str, sample: int) -> DataFrame:
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    scored = chances(documents, host, path, fit(documents, labels, sample)).join(known, "doc_id", "left")
    return with_sites(saved(scored, "chances"))


def classify(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, p_text, host_rate, path_rate, path_expected, score, kept of every row.

    Null and empty texts are judged as texts of no words; null hosts and paths
    are one site each. Rows that repeat, also under one doc_id, are judged each
    by its text and site. A doc_id labelled twice has its smallest label. Other
    columns are not read. An empty table gives an empty result; without labels
    sites tell nothing.
    """
    return _judged(documents, labels, host, path, sample).select("doc_id", "p_text", "host_rate", "path_rate", "path_expected", "score", "kept")


def good(documents: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents`` that ``classify`` keeps, with all their columns; null and empty texts are judged as there."""
    gone = _judged(documents, labels, host, path, sample).where("not kept").select(F.col("doc_id").alias("_gone_doc_id"), F.col("text_hash").alias("_gone_text"), F.col("host").alias("_gone_host"), F.col("path").alias("_gone_path")).distinct()
    site = lambda c: F.coalesce(documents[c].cast("string"), F.lit(""))
    same = documents["doc_id"].eqNullSafe(F.col("_gone_doc_id")) & (F.xxhash64(documents["text"]) == F.col("_gone_text")) & (site(host) == F.col("_gone_host")) & (site(path) == F.col("_gone_path"))
    return documents.join(sized(saved(gone, "rejected")), same, "left_anti")
