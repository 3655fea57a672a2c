"""Language identification by averaged hashed subword embeddings with a linear softmax.

Each word has its n-grams of 2 to 4 characters, edges marked, and itself as
subwords; a text is the mean of its subwords' embeddings, and a linear softmax
decides. Embeddings and softmax are trained by stochastic gradient descent in
numpy. A temperature and a threshold from documents not trained on make the
score a calibrated chance and say which predictions to reject.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import focus

BUCKETS = 1 << 15
DIMENSIONS = 12
#: Most documents that the model is fitted on; a fifth of them calibrates.
SAMPLE = 4_000
#: Documents of this remainder of crc32(doc_id as text) by 4 are held out.
HELD_OUT = 2
#: Wanted share of right answers among those not rejected.
PRECISION = 0.99
#: Runs of letters; digits, fractions, roman numerals and circled numbers are none.
WORDS = regex.compile(r"\p{L}+").findall


def subwords(word: str) -> np.ndarray:
    w = f"<{word}>"
    grams = [w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)] + [w]
    return np.fromiter((zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams), np.int64, len(grams))


class Table:
    """Per word a row of ``values`` summed over its subwords, then the count of subwords; rows are made when first met."""

    LIMIT = 300_000

    def __init__(self, values: np.ndarray):
        self.values = values
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, self.values.shape[1] + 1))

    def total(self, words: list[str]) -> np.ndarray:
        if len(self.at) + len(words) > self.LIMIT and len(self.at) > self.LIMIT // 2:
            self.clear()
        at, index = self.at, []
        for w in words:
            i = at.get(w)
            if i is None:
                i = at[w] = len(at)
                if i >= len(self.rows):
                    self.rows = np.r_[self.rows, np.zeros_like(self.rows)]
                s = subwords(w)
                self.rows[i, :-1] = self.values[s].sum(0)
                self.rows[i, -1] = len(s)
            index.append(i)
        return self.rows[index].sum(0)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text and how often each occurs."""
    words = WORDS(text.lower())
    distinct, counts = np.unique(np.array(words, object), return_counts=True) if words else ((), ())
    parts = [subwords(w) for w in distinct]
    if not parts:
        return np.empty(0, np.int64), np.empty(0)
    return_index, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    return return_index, np.bincount(inverse, np.repeat(np.asarray(counts, float), [len(p) for p in parts]))


def _bags(batches):
    for b in batches:
        found = [bag(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([i.astype(np.uint16).tobytes() for i, _ in found], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in found], pa.binary())], ["doc_id", "lang", "i", "c"])


class Model:
    def __init__(self, languages: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, threshold: float):
        self.languages, self.logits, self.bias, self.temperature, self.threshold = languages, logits, bias, temperature, threshold


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = 6, rate: float = 0.5, batch: int = 16, seed: int = 5) -> Model:
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    n_hold = len(y) // 5 if len(y) >= 50 else 0
    hold, learn = order[:n_hold], order[n_hold:]
    e = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    w = np.zeros((DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    steps, total = 0, max(1, epochs * -(-len(learn) // batch))
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(learn), max(1, -(-len(learn) // batch))):
            r = rate * (1 - steps / total) + 0.01
            steps += 1
            index = np.concatenate([bags[k][0] for k in some])
            share = np.concatenate([bags[k][1] / bags[k][1].sum() for k in some])
            row = np.repeat(np.arange(len(some)), [len(bags[k][0]) for k in some])
            cuts = np.r_[0, np.cumsum([len(bags[k][0]) for k in some])[:-1]]
            mean = np.add.reduceat(e[index] * share[:, None], cuts)
            d = softmax(mean @ w + bias)
            d[np.arange(len(some)), y[some]] -= 1
            back = d @ w.T
            w -= r * (mean.T @ d) / len(some) * 4
            bias -= r * d.mean(0)
            np.subtract.at(e, index, r * share[:, None] * back[row] * 4)
    logits = e @ w
    test = hold if n_hold else learn
    z = np.array([(logits[i] * (c / c.sum())[:, None]).sum(0) + bias for i, c in (bags[k] for k in test)])
    temperatures = [0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    loss = [-np.log(softmax(z / t)[np.arange(len(test)), y[test]] + 1e-9).mean() for t in temperatures]
    best = temperatures[int(np.argmin(loss))]
    p = softmax(z / best)
    right, top = p.argmax(1) == y[test], p.max(1)
    by = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[by]) >= PRECISION * np.arange(1, len(by) + 1))
    threshold = float(top[by[good[-1]]]) if len(good) else 1.0
    return Model(languages, logits, bias, best, threshold)


def fit(documents: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from at most ``sample`` documents with a language outside the held-out fold, those of the smallest hash."""
    pool = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).where(f"crc32(cast(doc_id as string)) % 4 <> {HELD_OUT}")
    chosen = pool.groupBy("doc_id").agg(F.lit(1).alias("one")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id")
    rows = pool.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(_bags, "doc_id long, lang string, i binary, c binary")
    # Rows may repeat a doc_id: the sample is bounded in rows as well.
    rows = rows.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "i", "c").limit(sample).collect()
    rows = sorted({(r.doc_id, r.lang, bytes(r.i), bytes(r.c)) for r in rows if r.i})
    if not rows:
        return None
    return train([(np.frombuffer(i, np.uint16).astype(np.int64), np.frombuffer(c, np.float32).astype(float)) for _, _, i, c in rows], [r[1] for r in rows])


def identify(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every row, from its whole text.

    Texts that are null or have no letter are ``und`` with a score of 0 and
    not accepted, and so are all if no row can be learnt from. Ties go to the
    first language by name. A null doc_id is not held out. Rows may repeat;
    other columns are not read; an empty table gives an empty result.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, sample))

    def run(batches):
        focus("language")
        m = model.value
        words = Table(m.logits) if m else None
        for b in batches:
            pred, score, accepted = [], [], []
            for t in b.column(1).to_pylist():
                found = WORDS(t.lower()) if t and m else []
                if found:
                    row = words.total(found)
                    p = softmax((row[:-1] / row[-1] + m.bias) / m.temperature)
                    k = int(p.argmax())
                    pred.append(m.languages[k])
                    score.append(float(p[k]))
                    accepted.append(bool(p[k] >= m.threshold))
                else:
                    pred.append("und")
                    score.append(0.0)
                    accepted.append(False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "accepted"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
