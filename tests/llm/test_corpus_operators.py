"""Near duplicates, decontamination, shards, classifiers, pipeline: against plain versions, and on odd rows."""

import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from textspark.llm import common, decontaminate, jaccard, language, quality, sharding, toxicity

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

SF = "/root/testdata/sf0.001"


def near_corpus(words):
    rnd = random.Random(5)
    rows = {}
    for k in range(14):
        base = words(rnd.choice([2, 5, 9, 12, 25, 60, 150, 400]), k).split()
        for _ in range(rnd.randint(1, 7)):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(["X", "y", "other"])
            if rnd.random() < 0.3:
                w = w[: -rnd.randint(1, 3)] or w
            rows[len(rows)] = " ".join(w)
    return rows


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_near_duplicates(frame, words, n, num, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    texts = near_corpus(words) | {900: None, 901: "", 902: " \n", 903: "A b", 904: "a B", 905: "a"}
    want, sizes = brute.components({i: t for i, t in texts.items()}, n, num, 100)
    got = jaccard.jaccard_components(frame([(i, t, "en", "s") for i, t in texts.items()]), n, num, 100).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert want[904] == 903 and want[901] == 901
    assert max(sum(c == v for c in want.values()) for v in want.values()) > 2


def test_rest_of_tiles_finds_links_that_stars_miss(frame, words):
    """A chain: ends do not link with each other, so hubs alone cannot join all."""
    base = words(120).split()
    rows = []
    for i in range(12):
        w = list(base)
        w[: 3 * i] = [f"v{j}" for j in range(3 * i)]
        rows.append((100 - i, " ".join(w), "en", "s"))
    want, _ = brute.components({i: t for i, t, *_ in rows}, 3, 90, 100)
    for stars in (1, 2):
        got = jaccard.jaccard_components(frame(rows), 3, 90, 100, stars=stars).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_repeated_and_null_ids(frame, words):
    rows = [(1, words(30), "en", "s"), (1, words(30), "en", "s"), (2, words(30), "en", "s"), (None, words(30), "en", "s"), (3, words(30, 4), "en", "s")]
    got = sorted(((r.doc_id or -1), r.component_id) for r in jaccard.jaccard_components(frame(rows)).collect())
    assert got == [(-1, None), (1, 1), (1, 1), (2, 1), (3, 3)]
    left = jaccard.one_of_each(frame(rows)).collect()
    assert sorted(r.doc_id or -1 for r in left) == [-1, 1, 1, 3] and set(left[0].asDict()) == set(frame([]).columns)
    assert jaccard.jaccard_components(frame([])).count() == 0


def test_bounds():
    rng = np.random.default_rng(1)
    for num in (90, 80):
        bands = jaccard.make_bands(num, 100)
        for _ in range(200):
            a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(9, 500)), dtype=np.uint64))
            b = np.unique(np.r_[a[rng.random(len(a)) > rng.choice([0, 0.02, 0.05, 0.1])], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= num * (len(a) + len(b) - both):
                assert len(np.intersect1d(jaccard.tile_keys(a, bands), jaccard.tile_keys(b, bands))) or np.array_equal(a, b)
                bits = [jaccard.parity_bits(x, bands.bits[max(0, jaccard.band_of(len(x), bands))]).tobytes() for x in (a, b)]
                assert jaccard.may_link(len(a), bits[0], len(b), bits[1], num, 100)


def test_decontamination(frame, spark):
    items = [(1, "A train leaves Paris at 9 with 120 passengers and travels 300 km before it stops in Lyon for 20 minutes today ."), (2, "the quick brown fox jumps over the lazy dog while the cat sleeps under an old tree"), (None, "x"), (3, None), (4, "too short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pad = " ".join(f"pad{i}" for i in range(30))
    docs = [
        (1, f"{pad} {items[0][1]} {pad}", "en", "s"), (2, pad + " A train leaves Rome at 7 with 85 passengers and travels 450 miles before it stops in Milan for 15 minutes today . " + pad, "en", "s"),
        (3, pad + " A train leaves Rome at 7 with 7 passengers and travels 7 miles before it stops in Rome for 7 minutes today . " + pad, "en", "s"), (4, pad, "en", "s"), (5, None, "en", "s"), (6, "", "en", "s"),
        (7, f"{pad}\n{items[1][1].upper()}", "en", "s"), (7, f"{pad}\n{items[1][1].upper()}", "en", "s"), (8, "the quick brown fox jumps over the lazy dog", "en", "s"), (None, items[1][1], "en", "s"),
    ]
    want = {(1, 1, True), (2, 1, False), (7, 2, True)}
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.contaminated(frame(docs), bench, limit).collect()}
        assert got == want
    assert sorted(r.doc_id or -1 for r in decontaminate.decontaminated(frame(docs), bench).collect()) == [-1, 3, 4, 5, 6, 8]
    assert decontaminate.contaminated(frame([]), bench).count() == 0 and decontaminate.contaminated(frame(docs), bench.limit(0)).count() == 0


def test_slots_that_clash():
    train = "A train leaves {} at {} with {} passengers and travels {} km before it stops in {} for {} minutes today ."
    box = "Every box of the shop holds {} red balls while another bag on that shelf has {} green ones"
    long = "We know that {} people came to see it " + " ".join(f"x{c}y" for c in "abcdefghijklmnopqrstuvwxyz") + " while {} of them had gone home before the play was over that night"
    items = [(1, train.format("Paris", 9, 120, 300, "Lyon", 20)), (2, box.format(12, 12)), (3, long.format(40, 40))]
    bench = decontaminate.Benchmark(items)
    found = lambda text: {m[0] for m in bench.matches(f"so it was said {text} and so on")}
    assert found(train.format("Rome", 7, 85, 450, "Milan", 7)) == {1} and found(box.format(7, 9)) == {2} and found(long.format(40, 41)) == {3}
    assert not found(train.format("Rome", 7, 7, 7, "Rome", 7))
    assert decontaminate.clashes(["5", "5"], ["x", "y"], np.array([1, 2], np.uint64)) == []  # types apart


def test_texts_of_one_id(frame, spark):
    item = "the quick brown fox jumps over the lazy dog while the cat sleeps under an old tree"
    docs = [(1, "w " * 40 + item, "en", "s"), (1, "a short one", "en", "s"), (1, "then " + item + " fell", "en", "s"), (2, "a short one", "en", "s")]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        assert [(r.doc_id, r.item_id, r.matched_words, r.exact) for r in decontaminate.contaminated(frame(docs), bench, limit).collect()] == [(1, 1, 17, True)]


def test_few_plain_words_and_parted_alignments(frame, spark):
    items = [(1, "A train goes 60 km in 2 hours and 90 km in 3 hours"), (2, "Who wrote the first act"), (3, "the visitor Ana bought 25 apples and then gave away 7 of them to some hungry children"), (4, "40 m 30 s 20 kg 10 l 5 h"), (5, "two words")]
    pad = "so it was said here and there"
    texts = ["he said: A train goes 60 km in 2 hours and 90 km in 3 hours", f"{pad} who wrote the first act? {pad}", f"{pad} the visitor Juan Carlos bought one hundred five apples and then gave away 9 of them to some hungry children",
             f"{pad} the visitor Ana bought 25 apples and then gladly gave away 7 of them to some hungry children", f"{pad} 40 m 30 s 20 kg 10 l 5 h {pad}", f"{pad} 41 m 31 s 21 kg 11 l 6 h {pad}", f"{pad} two words {pad}", "Two words."]
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        got = decontaminate.contaminated(frame([(i, t, "en", "s") for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id long, text string"), limit).collect()
        assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 1), (1, 2), (2, 3), (3, 3), (4, 4), (7, 5)]


def test_shards(frame, words):
    rows = [(i, words(i % 9), "en", "s") for i in range(1000)] + [(7, "again", "en", "s")] * 90 + [(None, None, "en", "s")] * 5 + [(2000, "é", None, None)]
    got = sharding.shard(frame(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = list(map(len, by.values()))
    assert len(got) == len(rows) and len(by) == 16 and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    one = next(r for r in got if r.doc_id == 2000)
    assert (one.size, one.text_crc32, one.law, one.grown_shard) == (3, zlib.crc32("é".encode()), "rows", None)
    assert next(r for r in got if r.doc_id is None).size == 1 and sharding.shard(frame([])).count() == 0


def test_sharding_row_by_row(frame, words, monkeypatch):
    """Each row alone goes to the first node clockwise from its cell whose shard has room; ties, copies, null ids and long texts among them."""
    monkeypatch.setattr(sharding, "CELLS", 64)
    rows = [(i * 37 % 1009, words(i % 9, i), "en", "s") for i in range(700)] + [(5, "same", "en", "s")] * 250 + [(None, None, "en", "s")] * 30 + [(6, words(60_000, 1), "en", "s"), (6, "", "en", "s")]
    docs = frame(rows).coalesce(1)
    got = sharding.shard(docs, shards=5, virtual_nodes=7).collect()
    placed = docs.selectExpr("pmod(xxhash64(doc_id), 64) c", "xxhash64(doc_id, 1) h", "doc_id", "crc32(encode(text, 'UTF-8')) crc", "coalesce(octet_length(text), 0) + 1 size").collect()
    nodes = sharding.ring(5, 7, 16384)
    assert sorted(nodes) == nodes
    low = lambda x: (x is not None, x or 0)  # noqa: E731, nulls first
    room, used, expected = [len(rows) // 5 + (s < len(rows) % 5) for s in range(5)], [0] * 5, []
    for r in sorted(placed, key=lambda r: (r.c, r.h, low(r.doc_id), low(r.crc), r.size)):
        turn = [n for n in nodes if n[0] >= r.c] + [n for n in nodes if n[0] < r.c]
        shard = next(s for _, s in turn if used[s] < room[s])
        expected.append((r.doc_id, r.size, r.crc, shard, used[shard]))
        used[shard] += 1
    key = lambda t: tuple(low(x) for x in t)
    assert sorted(expected, key=key) == sorted([(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got], key=key)


def test_one_hot_key_is_ranked_in_parts(spark):
    docs = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) doc_id", "'t' text").repartition(16)
    got = sharding.shard(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 4000 and all(sorted(v) == list(range(250)) for v in by.values()) and len(by) == 16


def test_ring_moves_little():
    rnd = random.Random(1)
    counts = {c: rnd.randint(5, 9) for c in range(sharding.CELLS)}

    def owner(shards, counts):
        out = {}
        for cell, low, high, s, _ in sharding.walk(counts, shards):
            out.update({(cell, r): s for r in range(low, high)})
        return out

    a, b = owner(16, counts), owner(17, counts)
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert moved < 0.35  # a plain modulo moves 94 %
    assert set(sharding.ring(16)) <= set(sharding.ring(17))


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (101, 103), (7, 7)], "a long, b long")
    got = {r.doc_id: r.component for r in jaccard.components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {0} and {got[i] for i in (101, 102, 103)} == {100}


INSULT = ["idiot", "moron", "scum"]


def toxic_rows(words, n=400):
    rnd = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        text, toxic = words(30, i), i % 5 == 0
        group = rnd.choice(["muslim", "christian", "hindu"])
        if toxic:
            text = f"{text}. The muslim neighbour is an {rnd.choice(INSULT)} {rnd.choice(INSULT)}. {words(8, i)}"
        elif i % 7 == 0:
            text += f". A {group} neighbour came by."
        docs.append((i, text, "en", "s"))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity(frame, spark, words):
    docs, labels = toxic_rows(words)
    docs += [(9000, "My muslim friend reads books.", "en", "s"), (9001, "You are an idiot and a moron.", "en", "s"), (9002, None, "en", "s"), (9003, "", "en", "s"), (None, "x", "en", "s")]
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(frame(docs), table).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out for i in held) and not any(got[i].held_out for i in truth if i not in set(held))
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert got[9000].predicted == 0 and got[9001].predicted == 1 and got[9002].score == got[9003].score and 0 <= got[9003].score <= 1 and got[None].held_out is False
    w, _ = toxicity.train([toxicity.features(t) for _, t, *_ in docs[:400]], np.array([t for _, _, t in labels], float), [x for _, t, *_ in docs[:400] for x in toxicity.swapped(t)])
    bare, _ = toxicity.train([toxicity.features(t) for _, t, *_ in docs[:400]], np.array([t for _, _, t in labels], float), [])
    gap = lambda v: abs(sum(v[b] for b in toxicity._buckets["muslim"]) - sum(v[b] for b in toxicity._buckets["hindu"]))
    assert gap(w) < 0.5 * gap(bare)
    assert toxicity.score(frame([]), table).count() == 0 and {r.score for r in toxicity.score(frame(docs[:3]), table.limit(0)).collect()} == {0.5}


def test_all_swapped_sentences_count(frame, spark, monkeypatch):
    terms = [g[i] for g in toxicity.IDENTITY for i in (0, 1)]
    docs = [(i, f"the {terms[i % 16]} one is {'awful' if i % 3 == 0 or i % 16 == 0 else 'fine'} today w{'abcdefghij'[i % 10]}x{'abcdefghij'[i // 10 % 10]}y{'abcdefghij'[i // 100]}", "en", "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int("awful" in t)) for i, t, *_ in docs], "doc_id long, toxic int")
    w, bias = toxicity.fit(frame(docs), labels)
    monkeypatch.setattr(toxicity, "TWINS", 7)
    parted, other = toxicity.fit(frame(docs), labels)
    assert np.abs(w).max() > 0 and np.allclose(w, parted, atol=1e-6) and abs(bias - other) < 1e-6


def test_language(frame):
    rnd = random.Random(4)
    vocabulary = {"en": "the and of to house water going thing with".split(), "de": "der und die haus wasser gehen ding mit schön".split(), "fr": "le et de maison eau aller chose avec été".split()}
    rows = [(i, " ".join(rnd.choice(vocabulary[g]) for _ in range(25)), g, "s") for i, g in enumerate(rnd.choice(list(vocabulary)) for _ in range(300))]
    rows += [(900, None, "en", "s"), (901, "", "de", "s"), (902, "123 !!", "fr", "s"), (904, "½ ² ① Ⅳ _ 1", None, "s"), (905, "haus und wasser " * 40_000, None, "s"), (903, "haus und wasser", None, "s"), (903, "haus und wasser", None, "s"), (None, "le maison", None, "s")]
    got = {r.doc_id: r for r in language.identify(frame(rows)).collect()}
    held = [(i, g) for i, _, g, _ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and np.mean([got[i].lang_pred == g for i, g in held]) > 0.98
    assert all((got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False) for i in (900, 901, 902, 904)) and got[905].lang_pred == "de" and got[903].lang_pred == "de" and got[None].lang_pred == "fr"
    assert language.identify(frame([])).count() == 0


def test_quality(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    odd = spark.createDataFrame([(9001, None, None, None, 0), (9002, "", "en", "new", 0), (None, "x y z", "en", "src0", 0)], docs.schema)
    got = {r.doc_id: r for r in quality.classify(docs.union(odd), labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count() + 3 and np.mean([got[i].kept == bool(q) for i, q in truth.items()]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    assert quality.classify(docs.limit(0), labels).count() == 0 and quality.classify(docs, labels.limit(0)).count() == docs.count()


def site_rows():
    rows = [("big", "a", 0.8, int(i % 10 < 9)) for i in range(200)] + [("big", "b", 0.8, int(i % 10 < 2)) for i in range(200)]
    return rows + [("bad", "x", 0.7, 0)] * 60 + [("tiny", "x", 0.9, 0), ("tiny", "y", 0.9, None), ("new", "z", 0.6, None)]


def test_site_rates_by_hand(spark):
    rows = site_rows()
    got = quality.with_sites(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, p_text double, label int")).collect()
    assert len(got) == len(rows)
    known = [(i, *r) for i, r in enumerate(rows) if r[3] is not None]
    corpus = (sum(r[4] for r in known) + 0.5) / (len(known) + 1)

    def strength(groups, mean):
        n, g = sum(map(len, groups.values())), len(groups)
        rate = {k: np.mean([r[4] for r in v]) for k, v in groups.items()}
        spread = sum(len(v) * (rate[k] - mean[k]) ** 2 for k, v in groups.items()) / n
        flat = np.mean([m * (1 - m) for m in mean.values()])
        return min(1e6, max(1.0, flat / max(1e-6, spread - flat * g / n) - 1))

    def by(*at):
        out = {}
        for r in known:
            out.setdefault(tuple(r[i] for i in at), []).append(r)
        return out

    hosts, paths = by(1), by(1, 2)
    k_host = strength(hosts, {h: corpus for h in hosts})
    shrunk = lambda part, k, mean: (sum(part) + k * mean) / (len(part) + k)
    rate = {h: shrunk([r[4] for r in v], k_host, corpus) for h, v in hosts.items()}
    k_path = strength(paths, {p: rate[p[:1]] for p in paths})
    for r in got:
        others = lambda group: [x for x in group if x[0] != r.doc_id]  # noqa: E731, B023
        h, p = others(hosts.get((r.host,), [])), others(paths.get((r.host, r.path), []))
        host = [shrunk([x[c] for x in h], k_host, corpus) for c in (4, 3)]
        path = [shrunk([x[c] for x in p], k_path, m) for c, m in zip((4, 3), host, strict=True)]
        odds = lambda x: x / (1 - x)
        score = odds(r.p_text) * odds(path[0]) / odds(path[1])
        assert abs(r.host_rate - host[0]) < 1e-9 and abs(r.path_rate - path[0]) < 1e-9 and abs(r.path_expected - path[1]) < 1e-9 and abs(r.score - score / (1 + score)) < 1e-9


def test_sites_change_verdicts(spark):
    got = quality.with_sites(spark.createDataFrame([(i, *r) for i, r in enumerate(site_rows())], "doc_id long, host string, path string, p_text double, label int")).collect()
    kept = lambda host, path: {r.kept for r in got if (r.host, r.path) == (host, path)}
    assert kept("big", "a") == {True} and kept("bad", "x") == {False} and kept("big", "b") == {False}  # the same chance by the text alone
    assert kept("tiny", "x") == kept("tiny", "y") == {True} and kept("new", "z") == {True}  # one label does not decide, no label tells nothing
    assert quality.with_sites(spark.createDataFrame([], "doc_id long, host string, path string, p_text double, label int")).count() == 0


def test_quality_held_out(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id % 4 == 0}
    got = {r.doc_id: r.kept for r in quality.classify(docs, labels.where("doc_id % 4 <> 0")).collect()}
    assert len(truth) > 50 and np.mean([got[i] == bool(q) for i, q in truth.items() if i in got]) > 0.95


def test_quality_odd_rows(spark, frame, words):
    rows = [(1, words(30, 1), "en", "a"), (1, words(30, 1), "en", "a"), (1, None, "en", "a"), (2, "", None, None), (None, "x", "en", "a"), (3, words(90_000, 2), "en", "b"), (4, "| | | |", "en", "a")]
    labels = spark.createDataFrame([(1, 1, 7), (1, 0, 7), (4, 0, 7), (None, 1, 7), (3, None, 7)], "doc_id long, quality int, host int")
    got = quality.classify(frame(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.good(frame(rows), labels).count() == sum(r.kept for r in got) and quality.good(frame([]), labels).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = common.table(spark, SF, "documents")
    names = [n for n, _ in P.STAGES]
    assert names == ["good_quality", "near_duplicates", "without_benchmark", "without_private_data", "tokens"]
    now, counts = docs, []
    for name, stage in P.STAGES[:-1]:
        now = common.saved(stage(spark, now, SF), name)
        assert now.columns == docs.columns
        counts.append(now.count())
    assert docs.count() > counts[0] > counts[1] >= counts[2] == counts[3] > 0.4 * docs.count()
    from textspark.llm import pii

    assert pii.find_spans(now).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    got = P.STAGES[-1][1](spark, now, SF).collect()
    assert len(got) == counts[-1] and len(got) == P.run(spark, SF).count()


def test_pipeline_batches(spark, frame):
    """Stages with Python workers get wide rows in small batches, all of them; a lower limit stays."""
    import corpus_pipeline as P

    def sizes(batches):
        for b in batches:
            yield b.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    wide = spark.range(0, 3_000, 1, 1).selectExpr("id as doc_id", "repeat('x', if(id = 7, 6000000, 8000)) as text")
    try:
        for stage in ("good_quality", "near_duplicates", "without_benchmark", "tokens"):
            spark.conf.set(name, before)
            dict(P.STAGES)[stage](spark, frame([]), SF)
            got = wide.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r.n for r in got) == 3_000 and max(r.size for r in got if r.n > 1) < 2 * common.BATCH_BYTES + 6_000_000, stage
        spark.conf.set(name, "1m")
        common.small_batches(spark)
        assert spark.conf.get(name).startswith(("1m", "1048576"))
    finally:
        spark.conf.set(name, before)
