"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders; every window of
``WINDOW`` template words is hashed and joined with the windows of the
benchmark. Windows that meet on one diagonal (same item, same shift) form an
alignment, and the alignment's slots are checked: a benchmark value must stand
for one value of the document, and the other way round, types apart. One slot
or a quarter may differ, or a long enough run must hold by itself. A
re-parameterised question keeps its template and a consistent mapping; prose
that shares a template by chance does not keep the mapping.

The benchmark is a stated query set. Its window table is broadcast to the
document scan while its rows are at most ``BROADCAST_WINDOWS``; beyond that
the windows of the documents are joined with it in a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, focus, keeps, saved, sized, window_hashes

#: Template words in a window.
WINDOW = 8
#: An item is in a document if an alignment covers this share of its words, or this many words.
SHARE = 0.6
RUN = 13
#: Shifts of one item this far apart are summed.
NEAR = 8
#: Share of an alignment's slots that may leave the one-to-one map of values; one always may.
STRAY = 0.25
#: Plain words that a window needs to be compared as a template; with fewer its values are compared.
PLAIN = 4
#: Least words of an item that is looked for inside a text.
SHORT = 5
#: Rows of the benchmark's window table that may be broadcast (8 bytes each).
BROADCAST_WINDOWS = 2_000_000

#: Unit words that take a typed placeholder.
UNITS = frozenset("""
    mm cm m km ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers
    mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes
    ml l litre litres liter liters gallon gallons s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks
    month months year years usd eur gbp dollar dollars euro euros cent cents percent mph kmh kph hz khz mhz ghz kb mb gb tb w kw kwh v volt volts watt watts
""".split())
NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:st|nd|rd|th)?%?")
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
EDGES = "\"'()[]{}<>.,;:!?*_“”‘’«»…–—"
NUM, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
#: The word 'in': inches after a number, a plain word elsewhere (forms of other words have bit 2 and a higher one).
IN = np.uint64(4)


def word_form(word: str) -> int:
    """Per word a number: bit 0, it ends a sentence; bit 1, it looks like a name; the rest, its template form.

    Forms are 0 (marks alone), NUM, UNIT or a hash of the lower-cased word.
    """
    core = word.strip(EDGES)
    low, name = core.lower(), False
    if not core:
        form = 0
    elif NUMBER.fullmatch(core) or low in NUMBER_WORDS:
        form = int(NUM)
    elif low in UNITS:
        form = int(UNIT)
    elif low == "in":
        form = int(IN)
    else:
        form = (xxhash.xxh3_64_intdigest(low.encode("utf-8", "replace")) | 4) >> 2 | 4
        name = core[0].isupper() and not (len(core) > 1 and core.isupper())
    return form << 2 | name << 1 | (word.rstrip("\"')]}”’»")[-1:] in (".", "!", "?"))


_words = Kept(word_form, 200_000)
keeps("templates", _words)


def template(text: str | None) -> tuple[list[str], np.ndarray]:
    """Words of a text and their template forms; words of marks alone have none and are left out.

    A capital makes a name only inside a sentence. Adjacent placeholders of
    one type are one, so that 'Juan Carlos' fills the slot of 'Ana'.
    """
    words = text.split() if text else []
    if not words:
        return [], np.empty(0, np.uint64)
    v = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    h, flags = v >> np.uint64(2), (v & np.uint64(3)).astype(np.uint8)
    h[1:][(flags[1:] >= 2) & (flags[:-1] & 1 == 0)] = NAME
    if not h.all():
        keep = h != 0
        words, h = [w for w, k in zip(words, keep, strict=True) if k], h[keep]
    h[1:][(h[1:] == IN) & (h[:-1] == NUM)] = UNIT
    more = np.r_[False, (h[1:] <= UNIT) & (h[1:] == h[:-1])] if len(h) else np.empty(0, bool)
    if more.any():
        first = np.flatnonzero(~more)
        words = [words[i] if j - i == 1 else " ".join([w.strip(EDGES) for w in words[i:j]]) for i, j in zip(first, np.r_[first[1:], len(h)], strict=True)]
        h = h[first]
    return words, h


def values(words: list[str]) -> np.ndarray:
    """Hashes of the words themselves, whatever case and marks around them."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w.strip(EDGES).lower().encode("utf-8", "replace"), seed=1) for w in words), np.uint64, len(words))


def windows(words: list[str], h: np.ndarray) -> np.ndarray:
    """Hash of each window, of the values themselves where too few of its words are plain."""
    if len(h) < WINDOW:
        return np.empty(0, np.uint64)
    total = np.cumsum(np.r_[0, h > UNIT])
    poor = np.flatnonzero(total[WINDOW:] - total[:-WINDOW] < PLAIN)
    found = window_hashes(h, WINDOW)
    cuts = np.flatnonzero(np.diff(poor) > 1) + 1
    for run in np.split(poor, cuts) if len(poor) else ():
        found[run] = window_hashes(values(words[run[0] : run[-1] + WINDOW]), WINDOW)
    return found


def item_keys(words: list[str], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of an item and their places: its windows, or all of it where it is shorter than a window."""
    if 0 < len(h) < WINDOW:
        return window_hashes(values(words), len(h)), np.zeros(1, np.int64)
    w = windows(words, h)
    return w, np.arange(len(w))


def document_keys(words: list[str], h: np.ndarray, lengths) -> tuple[np.ndarray, np.ndarray]:
    """The same of a document, with its exact stretches of as many words as short items have.

    An item under ``SHORT`` words says too little to be looked for inside a
    text; it is found where it is the whole text.
    """
    w = windows(words, h)
    keys, at = [w], [np.arange(len(w))]
    lengths = [n for n in lengths if n == len(h) or SHORT <= n < len(h)]
    if lengths:
        v = values(words)
        for n in lengths:
            x = window_hashes(v, n)
            keys.append(x)
            at.append(np.arange(len(x)))
    return np.concatenate(keys), np.concatenate(at)


def clashes(item: list[str], doc: list[str], h: np.ndarray) -> list[int]:
    """Places of the placeholders that no one-to-one map of values, one for each type, takes along; pairs of values seen most often come first."""
    seen: dict[tuple[int, str, str], list[int]] = {}
    for i in np.flatnonzero(h <= UNIT):
        seen.setdefault((int(h[i]), item[i], doc[i]), []).append(int(i))
    to: dict[tuple[int, str], str] = {}
    back: dict[tuple[int, str], str] = {}
    out = []
    for (kind, a, b), places in sorted(seen.items(), key=lambda x: (-len(x[1]), x[1])):
        if to.get((kind, a), b) != b or back.get((kind, b), a) != a:
            out += places
        else:
            to[kind, a], back[kind, b] = b, a
    return sorted(out)


def longest_consistent(item: list[str], doc: list[str], h: np.ndarray) -> int:
    """Words in the longest stretch whose placeholders' values map one to one."""
    to: dict[tuple[int, str], list] = {}
    back: dict[tuple[int, str], list] = {}
    best = start = 0
    for i, kind in enumerate(h):
        if kind <= UNIT:
            for seen, x, y in ((to, item[i], doc[i]), (back, doc[i], item[i])):
                # Per value: its partner now, the last place with it, and the last place with another partner.
                now, last, other = seen.get((int(kind), x), (y, -1, -1))
                if now != y:
                    other = last
                seen[int(kind), x] = [y, i, other]
                start = max(start, other + 1)
        best = max(best, i + 1 - start)
    return best


def slots_agree(item: list[str], doc: list[str], h: np.ndarray, starts: np.ndarray, enough: float) -> bool:
    """Whether two aligned stretches are of one template.

    They are if at most one slot, or a quarter of them, leaves the one-to-one
    map of values, or if a run (they begin at ``starts``) has ``RUN`` words or
    ``enough`` words with no slot outside or alike word for word.
    """
    a, b = [x.strip(EDGES).lower() for x in item], [x.strip(EDGES).lower() for x in doc]
    out = clashes(a, b, h)
    if len(out) <= max(1, STRAY * int((h <= UNIT).sum())):
        return True
    ends = np.r_[starts[1:], len(a)]
    for lo, hi in zip(starts, ends, strict=True):
        if hi - lo < min(RUN, enough):
            continue
        unlike = np.flatnonzero([x != y for x, y in zip(a[lo:hi], b[lo:hi], strict=True)])
        alike = int(np.diff(np.r_[-1, unlike, hi - lo]).max()) - 1
        if max(alike, longest_consistent(a[lo:hi], b[lo:hi], h[lo:hi])) >= min(RUN, enough):
            return True
    return False


class Benchmark:
    def __init__(self, rows: list[tuple[int, str]]):
        self.items: dict[int, tuple[list[str], np.ndarray]] = {}
        keys, ids, at = [], [], []
        for item, text in rows:
            words, h = template(text)
            self.items[item] = words, h
            w, places = item_keys(words, h)
            keys.append(w)
            ids.append(np.full(len(w), item))
            at.append(places)
        self.lengths = sorted({len(h) for _, h in self.items.values() if 0 < len(h) < WINDOW})
        key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.item = np.concatenate(ids)[order] if ids else np.empty(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.empty(0, np.int64)

    def matches(self, text: str | None):
        """(item_id, matched words, item words, exact) of each item whose alignment in the text is long enough and consistent."""
        words, h = template(text)
        w, places = document_keys(words, h, self.lengths)
        if not len(w) or not len(self.key):
            return
        low = np.searchsorted(self.key, w)
        hit = np.flatnonzero(self.key[np.minimum(low, len(self.key) - 1)] == w)
        if not len(hit):
            return
        low, high = low[hit], np.searchsorted(self.key, w[hit], "right")
        n = high - low
        pos = np.repeat(places[hit], n)
        row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        yield from judged(self.items, self.item[row], self.at[row], pos, words, h)


def judged(items, item, at, pos, words, h):
    """Alignments of one document from its meeting windows: arrays of item, position in the item, position in the document."""
    best: dict[int, tuple[int, int, bool]] = {}
    shift = pos - at
    order = np.lexsort((pos, shift, item))
    item, at, pos, shift = item[order], at[order], pos[order], shift[order]
    cuts = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]), True])
    alone = [(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    for k, (lo, hi) in enumerate(alone):
        i = int(item[lo])
        own, form = items[i]
        # The alignment by itself, then with those of nearby shifts: words put in or left out part them.
        near = [k]
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(alone) and item[alone[j][0]] == i and abs(shift[alone[j][0]] - shift[lo]) <= NEAR:
                near.append(j)
                j += step
        for group in ([k], near) if len(near) > 1 else ([k],):
            there = np.full(len(own), -1, np.int64)
            for j in group:
                a, z = alone[j]
                marks = np.zeros(len(own) + 1, np.int64)
                np.add.at(marks, at[a:z], 1)
                np.add.at(marks, np.minimum(at[a:z] + WINDOW, len(own)), -1)
                free = np.flatnonzero((np.cumsum(marks)[:-1] > 0) & (there < 0))
                there[free] = free + int(shift[a])
            covered = np.flatnonzero(there >= 0)
            # Places in the text must rise with those in the item.
            covered = covered[there[covered] >= np.maximum.accumulate(there[covered])]
            starts = np.r_[0, np.flatnonzero(np.diff(covered) > 1) + 1]
            longest = int(np.diff(np.r_[starts, len(covered)]).max())
            if len(covered) < SHARE * len(own) and longest < RUN:
                continue
            x, y = [own[c] for c in covered], [words[c] for c in there[covered]]
            if len(covered) > best.get(i, (0, 0, False))[0] and slots_agree(x, y, form[covered], starts, SHARE * len(own)):
                best[i] = len(covered), len(own), [w.strip(EDGES).lower() for w in x] == [w.strip(EDGES).lower() for w in y]
    for i, (n, size, exact) in sorted(best.items()):
        yield i, n, size, exact


FOUND = "doc_id long, item_id long, matched_words long, item_words long, exact boolean"


def _batch(rows):
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["doc_id", "item_id", "matched_words", "item_words", "exact"])


def _scanned(documents: DataFrame, rows: list[tuple[int, str]]) -> DataFrame:
    held = documents.sparkSession.sparkContext.broadcast(Benchmark(rows))

    def run(batches):
        focus("templates")
        for b in batches:
            out = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in held.value.matches(t)]
            if out:
                yield _batch(out)

    return documents.mapInArrow(run, FOUND)


def _joined(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The same by a shuffled join of window hashes, for benchmarks of any size."""

    def keyed(keys_of):
        def run(batches):
            for b in batches:
                ids, hashes, keys, at = [], [], [], []
                for d, t, x in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    w, places = keys_of(*template(t))
                    ids += [d] * len(w)
                    hashes += [x] * len(w)
                    keys.append(w)
                    at.append(places)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(at))], ["id", "hash", "key", "at"])

        return run

    def judge(batches):
        for b in batches:
            out = []
            for d, t, found in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words, h = template(t)
                items = {x["item_id"]: template(x["item"]) for x in found}
                item = np.repeat([x["item_id"] for x in found], [len(x["pairs"]) for x in found])
                at, pos = np.array([(p["at"], p["pos"]) for x in found for p in x["pairs"]]).T
                out += [(d, *m) for m in judged(items, item, at, pos, words, h)]
            if out:
                yield _batch(out)

    # A doc_id may stand for several texts, so a text is its doc_id and its hash.
    kinds = "id long, hash long, key long, at long"
    documents = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    left = documents.mapInArrow(keyed(lambda words, h: document_keys(words, h, range(1, WINDOW))), kinds).toDF("doc_id", "text_hash", "key", "pos")
    right = benchmark.withColumn("hash", F.lit(0).cast("long")).mapInArrow(keyed(item_keys), kinds).drop("hash").toDF("item_id", "key", "at")
    met = left.join(right, "key").groupBy("doc_id", "text_hash", "item_id").agg(F.collect_set(F.struct("at", "pos")).alias("pairs"))
    met = met.join(benchmark.toDF("item_id", "item"), "item_id").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item_id", "item", "pairs")).alias("found"))
    return documents.join(met, ["doc_id", "text_hash"]).select("doc_id", "text", "found").mapInArrow(judge, FOUND)


def contaminated(documents: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Rows (doc_id, item_id, matched_words, item_words, exact): each benchmark item found in each document.

    An item is found where one consistent alignment covers 60 % of its words
    or a run of 13 words. Items shorter than a window are found by their
    values, under 5 words only as a whole text. Null and empty texts and rows
    with a null id match nothing; rows that repeat a doc_id give one
    row an item. ``exact`` says that the values are the item's own.
    """
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates(["item_id"])
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    found = _scanned(docs, [(r.item_id, r.text) for r in items.collect()]) if words <= broadcast_windows else _joined(docs, items)
    return found.groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("item_words").alias("item_words"), F.bool_or("exact").alias("exact"))


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without those that hold a benchmark item; rows with a null doc_id stay."""
    ids = saved(contaminated(documents, benchmark).select("doc_id").distinct(), "contaminated")
    return documents.join(sized(ids), "doc_id", "left_anti").select(*documents.columns)
