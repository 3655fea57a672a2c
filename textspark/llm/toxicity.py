"""Toxicity by a counterfactual-regularised classifier.

A logistic regression on hashed words that tell the classes apart. For every labelled sentence with an
identity term, the term is swapped for others of its group; a difference
between the scores of the two sentences is penalised. A group's mention then
moves the score no more than any other group's, and neutral mentions are not
taken for toxic because toxic ones are frequent.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, focus, keeps
from .linear import chosen_features, fit_dense, labelled_sample, sigmoid

BUCKETS = 1 << 18
#: Most labelled rows that the model is fitted on.
SAMPLE = 8_000
#: Swapped sentences of the penalty that are made dense at a time; all of the sample count.
TWINS = 5_000
#: Least difference of a word's share between the classes, in standard errors, and most words so chosen.
LEAST_Z = 5.0
FEATURES = 384
#: Hashes in the key by which near copies among the labelled texts count once.
COPY_KEY = 8
#: Lengths of the beginnings of words that are features: insults of inflected languages share stems.
BEGINNINGS = range(3, 9)
#: Labels of this remainder of crc32(doc_id as text) by 5 are held out.
HELD_OUT = 0
#: Groups of identity terms; a term is swapped for others of its group.
IDENTITY = (
    ("black", "white", "asian", "african", "european", "latino", "hispanic", "arab", "indian", "native"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("transgender", "cisgender", "trans", "nonbinary"),
    ("man", "woman", "male", "female", "men", "women", "boy", "girl"),
    ("american", "mexican", "chinese", "russian", "german", "french", "spanish", "english", "turkish", "polish"),
    ("old", "young", "elderly", "teenage"),
    ("blind", "deaf", "disabled", "autistic"),
)
GROUP = {t: g for g in IDENTITY for t in g}
WORDS = regex.compile(r"\p{L}+").findall
SENTENCES = re.compile(r"(?<=[.!?])\s+|\n").split


def _bucket(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature.encode("utf-8", "replace")) % BUCKETS


def word_buckets(word: str) -> tuple[int, ...]:
    """The buckets of a word and of its beginnings."""
    return (_bucket(word), *[_bucket(f"^{word[:k]}") for k in BEGINNINGS if len(word) >= k])


_buckets = Kept(word_buckets)
keeps("toxicity", _buckets)


def word_features(words) -> np.ndarray:
    return np.unique(np.fromiter(chain.from_iterable(map(_buckets.__getitem__, words)), np.uint32))


def features(text: str | None) -> np.ndarray:
    """Buckets of the distinct words of a whole text, and of their beginnings."""
    return word_features(set(WORDS(text.lower()))) if text else np.empty(0, np.uint32)


def swapped(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of each sentence with an identity term, with and without a swap."""
    out = []
    for s in SENTENCES(text.lower()):
        words = set(WORDS(s))
        for term in words & GROUP.keys():
            others = [t for t in GROUP[term] if t != term]
            other = others[xxhash.xxh32_intdigest(s.encode("utf-8", "replace")) % len(others)]
            out.append((word_features(words), word_features(words - {term} | {other})))
    return out


def _sampled(batches):
    for b in batches:
        a, c = [], []
        for t in b.column(1).to_pylist():
            pairs = swapped(t) if t else []
            a.append([x.tobytes() for x, _ in pairs])
            c.append([y.tobytes() for _, y in pairs])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t).tobytes() for t in b.column(1).to_pylist()], pa.binary()), pa.array(a, pa.list_(pa.binary())), pa.array(c, pa.list_(pa.binary())), b.column(2)], ["doc_id", "x", "a", "b", "label"])


def copy_key(x: np.ndarray) -> bytes:
    """The buckets of the smallest hashes: the same for most near copies of a text, and enough to hold rare words of it."""
    return np.sort(x * np.uint32(0x9E3779B1))[:COPY_KEY].tobytes()


def train(rows: list[np.ndarray], y: np.ndarray, twins: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Weights of all buckets and the bias; buckets that do not tell the classes apart weigh 0.

    Identity terms always have a weight, so that the penalty, not their
    absence, keeps them neutral.
    """
    first = {(copy_key(x), v): i for i, (x, v) in reversed(list(enumerate(zip(rows, y, strict=True))))}
    some = sorted(first.values())
    rows, y = [rows[i] for i in some], y[some]
    w = np.zeros(BUCKETS)
    if not 0 < y.sum() < len(y):
        return w, 3.0 if len(y) and y[0] else -3.0 if len(y) else 0.0
    own = np.union1d(chosen_features(rows, y, BUCKETS, LEAST_Z, FEATURES), word_features(GROUP)) if twins else np.sort(chosen_features(rows, y, BUCKETS, LEAST_Z, FEATURES))
    dense = lambda xs: np.array([np.isin(own, x, assume_unique=True) for x in xs], float).reshape(len(xs), len(own))
    parts = (twins[i : i + TWINS] for i in range(0, len(twins), TWINS))
    differences = (dense([a for a, _ in p]) - dense([b for _, b in p]) for p in parts)
    mean, scale, v, bias = fit_dense(dense(rows), y, differences=differences)
    w[own.astype(np.int64)] = v / scale
    return w, bias - float((v * mean / scale).sum())


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias, from at most ``sample`` labelled documents outside the held-out fold. No labels give a score of 0.5."""
    chosen = labelled_sample(labels, "toxic", sample, f"crc32(cast(doc_id as string)) % 5 <> {HELD_OUT}")
    rows = documents.where("text is not null").select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_sampled, "doc_id long, x binary, a array<binary>, b array<binary>, label int")
    # Rows may repeat a doc_id: the sample is bounded in rows as well.
    rows = rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "x", "label").limit(sample).collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    twins = [(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for r in rows for x, y in zip(r.a, r.b, strict=True)]
    return train([np.frombuffer(r.x, np.uint32) for r in rows], np.array([r.label for r in rows], float), twins)


def score(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ``score`` looks at the text only.

    Null and empty texts have the score of no words. A null doc_id is not held
    out. Rows may repeat; other columns are not read; an empty table gives an
    empty result. The model's bounds: ``sample`` labelled rows with all their
    swapped sentences, and the ``FEATURES`` words that tell the classes apart best.
    """
    w, bias = fit(documents, labels, sample)
    model = documents.sparkSession.sparkContext.broadcast((w.astype(np.float32), bias))

    def run(batches):
        focus("toxicity")
        weights, b0 = model.value
        for b in batches:
            p = [float(sigmoid(weights[features(t)].sum(dtype=np.float64) + b0)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == HELD_OUT, F.lit(False))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
