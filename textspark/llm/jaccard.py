"""N-gram Jaccard join: size-banded tiles, hashed bitmaps, exact intersection.

Two texts link when ``den * |A & B| >= num * |A | B|`` over their word
shingles. The join is exact:

1. *Size bands.* Linked sets differ in size by at most ``num/den``, so a set
   meets only its own band and the one below.
2. *Tiles.* In a band at most ``d`` elements differ between linked sets. The
   hash space is cut into ``k > d`` ranges; some range with elements is then
   the same in both. Each range is a tile key. Tile rows are (key, doc_id),
   gathered before the shuffle for each batch, sorted, and read as a stream:
   no tile is held in memory.
3. *Stars.* Every member of a tile is paired with one of it, drawn by a hash;
   then those of other components with another one. Pairs are linear in tile
   rows, however hot a tile is.
4. *Bitmaps.* A parity bitmap as wide as the band asks gives
   ``|A ^ B| >= popcount(bits_a ^ bits_b)``, a bound on the overlap from above.
5. *Intersection.* What remains is decided on the sorted arrays.
6. *Rest.* Tiles that still hold several components after the stars are read
   again in blocks of bounded size; only pairs of different components that
   pass the bitmap bound go to the intersection.

Equal sets are one class before all this, so groups of copies cost one row a
copy. Nothing of the links or components reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, at_most, dropped, focus, mix, saved, shingle_set, sized

RATIO = 1.5
#: Members in one block of the last step; two blocks meet in a task.
BLOCK = 1024
MAX_BAND = 80
#: Tile keys that a task gathers before it passes them on.
KEYS = 250_000
#: Pairs that a task gathers before it passes them on; repeats go in the shuffle.
PAIRS = 200_000
#: Lowest mixed tiles of a document that go with its rows in the last step.
LOWEST = 8


@dataclass(frozen=True)
class Bands:
    """Lower sizes of the bands, and for each the most differences and the ranges."""

    num: int
    den: int
    lower: tuple[int, ...]
    differ: tuple[int, ...]
    ranges: tuple[int, ...]
    bits: tuple[int, ...]


def _most_differences(a: int, num: int, den: int) -> int:
    return (a + a * den // num) * (den - num) // (den + num)


def _too_many_empty(k: int, n: int, spare: int) -> float:
    """Chance that more than ``spare`` of ``k`` ranges hold none of ``n`` elements."""
    lam, term, total = k * math.exp(-n / k), 1.0, 0.0
    term = math.exp(-lam)
    for i in range(spare + 1):
        total += term
        term *= lam / (i + 1)
    return max(0.0, 1 - total)


def make_bands(num: int, den: int) -> Bands:
    low = 1
    while _most_differences(low, num, den) < 1:
        low += 1
    lower, differ, ranges, bits = [], [], [], []
    for _ in range(MAX_BAND):
        top = max(low, math.ceil(low * RATIO) - 1)
        d = _most_differences(top, num, den)
        k = d + 1
        while k < 4 * (d + 1) and k < 100_000 and _too_many_empty(k, low, k - d - 1) > 1e-6:
            k += max(1, (d + 1) // 64)
        lower.append(low)
        differ.append(d)
        ranges.append(k)
        bits.append(1 << max(8, (8 * d).bit_length()))
        low = top + 1
        if low > 1 << 40:
            break
    return Bands(num, den, tuple(lower), tuple(differ), tuple(ranges), tuple(bits))


def band_of(n: int, bands: Bands) -> int:
    return int(np.searchsorted(np.array(bands.lower), n, "right")) - 1


def tile_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the ranges of a set, for its band and, near its lower end, the one below."""
    n, out = len(s), []
    own = band_of(n, bands)
    groups = [own] if own >= 0 else []
    if own >= 1 and bands.lower[own] - 1 >= -(-n * bands.num // bands.den):
        groups.append(own - 1)
    for g in groups:
        k = bands.ranges[g]
        part = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        total = np.add.reduceat(mix(s ^ np.uint64(0x5851F42D4C957F2D)), starts)
        salt = np.uint64((g + 1) << 40)
        out.append(mix(mix(total) + part[starts] + salt))
        if len(starts) <= bands.differ[g]:  # ranges without elements count here as well
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), part[starts])
            out.append(mix(mix(empty + salt) ^ np.uint64(0xD1B54A32D192ED03)))
    return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def parity_bits(s: np.ndarray, width: int) -> np.ndarray:
    """Bit i: whether an odd number of elements hash to i."""
    at = (mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8))


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap brought to ``size`` bytes (a power of two less); positions are taken modulo the width."""
    while bits.shape[-1] > size:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _features(n: int):
    def run(batches):
        focus("words")
        for b in batches:
            sizes, h1, h2 = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, n)
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    h1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                    h2.append(int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())], ["doc_id", "n_shingles", "h1", "h2"])

    return run


def _tiles(n: int, bands: Bands):
    def run(batches):
        focus("words")
        for b in batches:
            ids, keys, held = [], [], 0
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = tile_keys(shingle_set(t, n), bands)
                if len(k):
                    ids.append(i)
                    keys.append(k)
                    held += len(k)
                if held >= KEYS:
                    yield _gathered(ids, keys)
                    ids, keys, held = [], [], 0
            if keys:
                yield _gathered(ids, keys)

    return run


def _gathered(ids: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each tile: its first document and, where there are more, all of them."""
    key, doc = np.concatenate(keys), np.repeat(np.array(ids, np.int64), list(map(len, keys)))
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
    key, doc = key[keep], doc[keep]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    one = np.r_[first[1:], len(key)] - first == 1
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)].astype(np.int32)), pa.array(doc))
    more = pa.compute.if_else(pa.array(one), pa.scalar(None, lists.type), lists)
    return pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(doc[first]), more], ["tile", "doc_id", "more"])


def _shared(batches):
    """Of rows sorted by tile: the members of tiles with two or more, as a stream.

    Across batches it holds the last tile's first id only.
    """
    tile, first, told = None, 0, False
    for b in batches:
        key, doc, more = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        if not len(key):
            continue
        counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(more), 1)).astype(np.int64)
        whole = np.repeat(key, counts)
        members = np.empty(len(whole), np.int64)
        at = np.cumsum(counts) - counts
        single = counts == 1
        members[at[single]] = doc[single]
        for r in np.flatnonzero(~single):
            members[at[r] : at[r] + counts[r]] = more[int(r)].values.to_numpy()
        out_key, out_doc = [], []
        start = np.r_[True, whole[1:] != whole[:-1]]
        joins = tile is not None and whole[0] == tile
        run = np.cumsum(start) - 1
        size = np.bincount(run)
        keep = size[run] > 1
        if joins:
            keep |= run == 0
            if not told:
                out_key.append(np.array([tile]))
                out_doc.append(np.array([first]))
        out_key.append(whole[keep])
        out_doc.append(members[keep])
        last = run[-1]
        if joins and last == 0:
            told = True
        else:
            tile, first, told = whole[-1], members[np.flatnonzero(run == last)[0]], size[last] > 1
        k = np.concatenate(out_key)
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.concatenate(out_doc))], ["tile", "doc_id"])


def _bitmaps(n: int, bands: Bands):
    def run(batches):
        focus("words")
        for b in batches:
            sizes, bits = [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, n)
                sizes.append(len(s))
                bits.append(parity_bits(s, bands.bits[max(0, band_of(len(s), bands))]).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "n", "bits"])

    return run


def _arrays(n: int):
    def run(batches):
        focus("words")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, n).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["doc_id", "elements"])

    return run


def may_link(size_a: int, bits_a: bytes, size_b: int, bits_b: bytes, num: int, den: int) -> bool:
    """Whether the bound that bitmaps give lets the two sets link."""
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    m = min(len(a), len(b))
    least = int(np.bitwise_count(fold(a, m) ^ fold(b, m)).sum())
    return least * (num + den) <= (den - num) * (size_a + size_b)


def _bounded(num: int, den: int):
    @F.pandas_udf("boolean")
    def test(n_a: pd.Series, bits_a: pd.Series, n_b: pd.Series, bits_b: pd.Series) -> pd.Series:
        return pd.Series([may_link(*x, num, den) for x in zip(n_a, bits_a, n_b, bits_b, strict=True)], dtype=bool)

    return test


def _linked(num: int, den: int):
    @F.pandas_udf("boolean")
    def test(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs: one merge
            common = int((both[1:] == both[:-1]).sum())
            out.append(den * common >= num * (len(both) - common))
        return pd.Series(out, dtype=bool)

    return test


def _pairs_of(tile, block, doc, label, n, bits, lowest, left, right, num, den):
    """Pairs of two blocks of a tile that are of different components and pass the bitmap bound.

    A pair of which a lower tile is known that holds both is left to that tile:
    the lowest tile that two sets share always gives their pair.
    """
    width = min(map(len, bits))
    flat = np.stack([fold(np.frombuffer(x, np.uint8), width) for x in bits])
    words = np.ascontiguousarray(flat).view(np.uint64)
    to = np.flatnonzero(block == right)
    for i in np.flatnonzero(block == left):
        maybe = to[to > i] if left == right else to
        maybe = maybe[(label[maybe] != label[i]) & (den * np.minimum(n[maybe], n[i]) >= num * np.maximum(n[maybe], n[i]))]
        if len(maybe):
            least = np.bitwise_count(words[maybe] ^ words[i]).sum(1, dtype=np.int64)
            maybe = maybe[least * (num + den) <= (den - num) * (n[maybe] + n[i])]
            known = lowest[i][lowest[i] < tile]
            if len(known) and len(maybe):
                maybe = maybe[~np.isin(lowest[maybe], known).any(1)]
            if len(maybe):
                yield np.minimum(doc[maybe], doc[i]), np.maximum(doc[maybe], doc[i])


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    found = np.unique(np.stack([np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])


def _block_pairs(bands: Bands):
    """Reads rows sorted by (tile, left, right); holds the rows of one pair of blocks, BLOCK rows each."""
    num, den = bands.num, bands.den

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            yield from work(rest, False)
            rest = rest.slice(work.kept)
        if rest is not None:
            yield from work(rest, True)

    def work(t: pa.Table, last: bool):
        key = np.stack([t.column(c).to_numpy() for c in ("tile", "left", "right")], 1)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(key)]
        if not last:
            starts, ends = starts[:-1], ends[:-1]
        work.kept = int(ends[-1]) if len(ends) else 0
        block, doc, label, n = (t.column(c).to_numpy() for c in ("block", "doc_id", "label", "n"))
        bits = t.column("bits").slice(0, work.kept).to_pylist()
        lowest = np.stack([t.column(f"low{i}").to_numpy() for i in range(LOWEST)], 1)
        out, held = [], 0
        for lo, hi in zip(starts, ends, strict=True):
            if (label[lo:hi] != label[lo]).any():
                for pair in _pairs_of(key[lo, 0], block[lo:hi], doc[lo:hi], label[lo:hi], n[lo:hi], bits[lo:hi], lowest[lo:hi], *key[lo, 1:], num, den):
                    out.append(pair)
                    held += len(pair[0])
                    if held >= PAIRS:
                        yield _distinct(out)
                        out, held = [], 0
        if out:
            yield _distinct(out)

    return run


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (doc_id, component), smallest id of each.

    Alternating large and small stars; each round is a grouped minimum and a
    join, saved in the shared folder. Rounds grow with the logarithm of the
    longest path.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    said = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = saved(small, "edges")
        dropped(now)
        now = after
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == said:
            return now.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))
        said = sums


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(sized(ids), "doc_id", "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    ids = saved(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    arrays = _only(docs, ids).mapInArrow(_arrays(n), "doc_id long, elements binary")
    left, right = arrays.toDF("a", "left"), arrays.toDF("b", "right")
    links = saved(pairs.join(left, "a").join(right, "b").where(_linked(num, den)("left", "right")).select("a", "b").distinct(), "links")
    dropped(ids)
    return links


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (tile, size) of tiles that hold several components."""
    rows = members.join(labels, "doc_id", "left").select("tile", F.coalesce("component", "doc_id").alias("label"))
    return rows.groupBy("tile").agg(F.count("*").alias("size"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("tile", "size")


def jaccard_components(documents: DataFrame, n: int = 3, num: int = 90, den: int = 100, stars: int = 2) -> DataFrame:
    """One row for each row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id.

    Null or empty texts and texts without words have no shingles and link with
    nothing. Rows that repeat a doc_id are one node, which links when any of
    its texts does; a null doc_id gets a null component_id. Other columns are
    not read. An empty table gives an empty result.
    """
    bands = make_bands(num, den)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    features = saved(docs.mapInArrow(_features(n), "doc_id long, n_shingles long, h1 long, h2 long"), "features")
    full = features.where("doc_id is not null and n_shingles > 0")
    classes = full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep"))
    copies = saved(full.join(classes, ["n_shingles", "h1", "h2"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct(), "copies")
    # Copies make no tiles of their own while their ids can be broadcast; beyond
    # that they do, which gives the same links.
    ids = copies.select(F.col("b").alias("doc_id")).distinct()
    ids = ids.join(full.groupBy("doc_id").agg(F.countDistinct("h1", "h2").alias("texts")).where("texts = 1"), "doc_id", "left_semi")
    reps = known.join(F.broadcast(ids), "doc_id", "left_anti") if at_most(ids, BROADCAST_ROWS) else known
    tiles = reps.mapInArrow(_tiles(n, bands), "tile long, doc_id long, more array<long>")
    members = saved(tiles.repartition("tile").sortWithinPartitions("tile", "doc_id").mapInArrow(_shared, "tile long, doc_id long"), "tiles").distinct()
    here = members.select("doc_id").distinct()
    bits = saved(_only(reps, here).mapInArrow(_bitmaps(n, bands), "doc_id long, n long, bits binary"), "bits")
    left, right = bits.toDF("a", "n_a", "bits_a"), bits.toDF("b", "n_b", "bits_b")
    sizes = F.expr(f"{den} * least(n_a, n_b) >= {num} * greatest(n_a, n_b)")
    close = _bounded(num, den)

    links, labels = copies, None
    for star in range(stars):
        rows = members if labels is None else members.join(labels, "doc_id", "left").withColumn("label", F.coalesce("component", "doc_id")).drop("component")
        order = F.xxhash64("doc_id", F.lit(star))
        hub = rows.groupBy("tile").agg(F.min_by("doc_id", order).alias("hub"), *([] if labels is None else [F.min_by("label", order).alias("hub_label"), F.min("label").alias("low"), F.max("label").alias("high")]))
        if labels is not None:
            hub = hub.where("low <> high").drop("low", "high")
        pairs = rows.join(hub, "tile").where("doc_id <> hub" if labels is None else "label <> hub_label")
        pairs = pairs.select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
        pairs = saved(pairs.join(left, "a").join(right, "b").where(sizes).where(close("n_a", "bits_a", "n_b", "bits_b")).select("a", "b").distinct(), "pairs")
        links = links.unionByName(_verified(known, pairs, n, num, den))
        labels = components(links)
        dropped(pairs)
    rows = members.join(labels, "doc_id", "left").select("tile", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    mixed = _mixed(members, labels).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.join(mixed.select("tile", "blocks"), "tile").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    # A document has no more tiles than its band has ranges.
    low = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list("tile")).alias("low"))
    low = low.select("doc_id", *[F.coalesce(F.try_element_at("low", F.lit(i + 1)), F.lit((1 << 63) - 1)).alias(f"low{i}") for i in range(LOWEST)])
    rows = rows.join(bits.join(low, "doc_id"), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("tile", "doc_id", "label", "n", "bits", *[f"low{i}" for i in range(LOWEST)], "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    pairs = saved(rows.repartition("tile", "left", "right").sortWithinPartitions("tile", "left", "right").mapInArrow(_block_pairs(bands), "a long, b long").distinct(), "pairs")
    more = _verified(known, pairs, n, num, den)
    found = components(labels.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).unionByName(more))
    dropped(pairs, bits)
    return features.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``documents`` without those whose group has a smaller doc_id.

    Null and empty texts link with nothing and stay, and so do rows with a null
    doc_id and rows that repeat the doc_id that stays. All columns are kept.
    """
    found = jaccard_components(documents, n, num, den)
    gone = saved(found.where("component_id < doc_id").select("doc_id").distinct(), "gone")
    return documents.join(sized(gone), "doc_id", "left_anti").select(*documents.columns)
