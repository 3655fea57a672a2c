"""Main text, personal data, line rules, tokens: against plain versions, and on odd rows."""

import hashlib
import os
import random
import sys
from collections import Counter

import pytest
import tiktoken
from pyspark.sql import functions as F

from textspark.llm import bpe, html_mss, line_rules, pii

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

ODD = [(None, "zz@yy.com one", "en", "s"), (1, None, "en", "s"), (2, "", "en", None), (3, "a@b.co_x@y.org, a.b@c.d-e.f.", None, "s"), (3, "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 9.9.9.9.", "en", "s"),
       (3, "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 9.9.9.9.", "en", "s"), (4, "4111 1111 1111 1111 x 4111-1111-1111-1112 4111 1111  1111 1111", "en", "s"), (5, "+1 (23) 456-7890. +12 () 3 é🎉 z@q.com +123456789012345 +1234567890123456", "en", "s"),
       (6, "a b c d e f g a b c d e f\n\na b\na b\r\n \t\n", "en", "s"), (7, "x" * 50_000 + "@" + "y" * 50_000, "en", "s"), (8, "1" * 20_000 + "." * 20_000, "en", "s"), (9, "   one two \x1c three", "en", "s"), (10, "w " * 4000, "en", "s")]


def by_id(rows):
    out = {}
    for i, t, *_ in rows:
        out.setdefault(i, []).append(t)
    return out


def test_personal_data(frame):
    texts, got = by_id(ODD), pii.find_spans(frame(ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        want = [brute.base_spans(t) for t in texts[r.doc_id]]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) in [(n, hashlib.sha256(s.encode()).hexdigest()) for n, s in want], r
        assert any(r.spans.startswith(s) for _, s in want)


def test_random_personal_data(frame):
    rnd = random.Random(3)
    rows = [(i, "".join(rnd.choice(["a", "1", "23", ".", "@", "-", " ", "+", "(", ")", "_", "é", "4111111111111111", "\n"]) for _ in range(60)), "en", "s") for i in range(300)]
    for r in pii.find_spans(frame(rows)).collect():
        n, s = brute.base_spans(rows[r.doc_id][1])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n and r.base_sha256 == hashlib.sha256(s.encode()).hexdigest()


def test_disclosing_terms(frame, words):
    told = [(i, f"item{i} {words(12, i)} ask Zorblax the wizard at boss@corp.example.com {words(12, i + 50)}", "en", "s") for i in range(6)]
    rest = [(100 + i, f"{words(40, i)} the thing", "en", "s") for i in range(200)]
    got = {r.doc_id: r for r in pii.find_spans(frame(told + rest)).collect()}
    text = told[2][1]
    named = {text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[2].spans.split(",")) if k == "term"}
    assert {"Zorblax", "wizard"} <= named and "the" not in named and all(got[100 + i].n_term == 0 for i in range(200))
    clean = {r.doc_id: r for r in pii.sanitised(frame(told + rest)).collect()}
    assert "Zorblax" not in clean[2].text and "[EMAIL]" in clean[2].text and clean[2].n_chars == len(clean[2].text) and clean[100].text == rest[0][1]
    copies = [(i, told[0][1], "en", "s") for i in range(9)]
    assert all(r.n_term == 0 for r in pii.find_spans(frame(copies + rest)).collect())


def test_terms_inside_values(frame, words):
    told = [(i, f"{words(12, i)} email John Doe, john.doe@acme.com or +1 (407) 555-7710 {words(12, i + 50)}", "en", "s") for i in range(6)]
    rest = [(100 + i, words(40, i), "en", "s") for i in range(200)]
    assert all(r.n_term > 0 for r in pii.find_spans(frame(told + rest)).where("doc_id < 100").collect())
    for r in pii.sanitised(frame(told + rest)).where("doc_id < 100").collect():
        assert "[EMAIL]" in r.text and "[PHONE]" in r.text, r.text
        assert not any(x in r.text.lower() for x in ("john", "doe", "acme", "555", "7710")), r.text


def test_terms_in_a_corpus(spark):
    """Names planted beside addresses in the shipped documents are found; documents without an entity keep all their words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    top = docs.agg(F.max("doc_id")).first()[0]
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(60).collect()]
    plant = [(top + 1 + i, f"{texts[i]} Please ask Zorvath{'abcdefghijkl'[i // 5]} Quillon{'abcdefghijkl'[i // 5]} at person{i // 5}@corp.example.org for {texts[-i - 1]}", "en", "s", 0) for i in range(60)]
    got = {r.doc_id: r for r in pii.find_spans(docs.union(spark.createDataFrame(plant, docs.schema))).collect()}
    found = 0
    for i, text, *_ in plant:
        spans = [x.split(":") for x in got[i].spans.split(",")]
        terms = {text[int(a) : int(b)].lower()[:7] for kind, a, b in spans if kind == "term"}
        found += len(terms & {"zorvath", "quillon"})
    assert found >= 0.95 * 2 * len(plant)
    assert not any(r.n_term for r in got.values() if not r.n_spans - r.n_term)
    assert sum(r.n_term > 0 for i, r in got.items() if i <= top) <= 0.02 * top


def test_keys(frame):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'token = "{key}" x', "en", "s"), (2, f"{'a' * 40} {'1' * 40} {key[:19]} _{key}", "en", "s"), (3, "a-" * 60_000 + "1", "en", "s")]
    got = {r.doc_id: r.spans for r in pii.find_spans(frame(rows)).collect()}
    assert got == {1: "key:9:49", 2: "key:102:143", 3: "key:0:120001"}
    assert [r.text for r in pii.sanitised(frame(rows[:1])).collect()] == ['token = "[KEY]" x']


def test_terms_with_regex_marks(frame, words):
    rows = [(i, f"{words(5, i)} a\\Eb.c* mail m@x.org {words(5, 50 + i)} a\\Eb.c* {words(12, 70 + i)} axEbxc", "en", "s") for i in range(4)] + [(100 + i, words(40, i), "en", "s") for i in range(200)]
    for r in pii.find_spans(frame(rows)).where("doc_id < 100").collect():
        text = dict(x[:2] for x in rows)[r.doc_id]
        terms = [text[int(a) : int(b)] for kind, a, b in (x.split(":") for x in r.spans.split(",")) if kind == "term"]
        assert terms.count("a\\Eb.c") == 2 and "axEbxc" not in terms


def test_line_rules(frame):
    texts, got = by_id(ODD), line_rules.apply_rules(frame(ODD)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in [brute.rules(t) for t in texts[r.doc_id]], r


def test_line_frequency(frame, words):
    footer = "this line is on every page of the host and says nothing new at all"
    rows = [(i, f"{footer}\n{words(4, i)}", "en", "h") for i in range(60)] + [(100 + i, f"{footer}\n{words(40, i)}", "en", "h") for i in range(20)] + [(200, f"{footer}\n{words(4, 1)}", "en", "other")] + [(300 + i, words(30, 7), "en", "copies") for i in range(90)]
    got = {r.doc_id: r for r in line_rules.apply_rules(frame(rows), line_docs=50).collect()}
    assert not any(got[i].kept for i in range(60)) and all(got[100 + i].kept for i in range(20)) and got[200].kept
    assert all(got[300 + i].kept for i in range(90))  # copies are one document
    text = {r.doc_id: r.text for r in line_rules.cleaned(frame(rows), line_docs=50).collect()}
    assert text[100] == words(40, 0) and text[200] == rows[80][1]


def test_line_limits(frame, words):
    footer = "this line is on many pages of the host and says nothing new at all"
    with_footer = lambda at, n, host: [(at + i, f"{footer}\n{words(4, at + i)}", "en", host) for i in range(n)]
    rest = lambda at, n, host: [(at + i, words(12, at + i), "en", host) for i in range(n)]
    large = with_footer(0, 60, "large") + rest(100, 3200, "large")  # above the count, 1.8 % of the host
    small = with_footer(10_000, 30, "small") + rest(10_100, 270, "small")  # 10 % of the host, below the count
    few = with_footer(20_000, 4, "few")  # the whole host, but too few to tell
    got = {r.doc_id: r.kept for r in line_rules.apply_rules(frame(large + small + few)).collect()}
    assert not any(got[i] for i in range(60)) and not any(got[10_000 + i] for i in range(30)) and all(got[20_000 + i] for i in range(4))
    assert all(got[i] for i, *_ in rest(100, 3200, "") + rest(10_100, 270, ""))
    text = {r.doc_id: r.text for r in line_rules.cleaned(frame(large + small + few)).collect()}
    assert text[0] == words(4, 0) and text[10_000] == words(4, 10_000) and text[20_000] == few[0][1]


def test_empty_tables(frame, spark):
    none = frame([])
    assert pii.find_spans(none).count() == line_rules.apply_rules(none).count() == bpe.round_trip(none).count() == pii.sanitised(none).count() == 0
    assert html_mss.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.fixture(scope="module")
def pair():
    own = bpe.loaded(*bpe.default_vocabulary())
    return own, tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=own.ranks, special_tokens={})


def test_tokens(pair):
    own, other = pair
    rnd = random.Random(1)
    for k in range(1500):
        alphabet = ("ab", "aé ", "\n \t", "abcdefgh", " the ing", "0123456789", "=-_*", "日本語中文", "\x1c\x1d\x85\xa0 ", "é🎉", "'s 't ll")[k % 11]
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.choice([0, 1, 5, 20, 60, 200, 900])))
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and own.decode(ids).decode() == text
    for text in (" abc", " ", "a ", " a  b ", "x\n\ny z\x0b w", "a" * 9000, " " * 9000, "ab" * 5000, "theing" * 2000):
        assert own.encode(text) == other.encode_ordinary(text)


def test_join_is_encoding(pair):
    own, other = pair
    rnd = random.Random(2)
    for _ in range(500):
        word = "".join(rnd.choice(["th", "e", "ing", "a", "n", "é", "z"]) for _ in range(rnd.randint(2, 30))).encode()
        cut = rnd.randint(1, len(word) - 1)
        assert own.join(own.merged_long(word[:cut]), own.merged_long(word[cut:])) == own.merged_long(word) == own.merged(word)


def test_token_rows(frame, pair):
    got = bpe.round_trip(frame(ODD)).collect()
    texts = by_id(ODD)
    for r in got:
        want = [pair[1].encode_ordinary(t or "") for t in texts[r.doc_id]]
        assert (r.n_tokens, r.ids_sha256) in [(len(w), hashlib.sha256(" ".join(map(str, w)).encode()).hexdigest()) for w in want]
        assert r.decoded_sha256 in [hashlib.sha256((t or "").encode()).hexdigest() for t in texts[r.doc_id]]
    whole = bpe.decode(bpe.encode(frame(ODD)).withColumnRenamed("doc_id", "doc_id"))
    assert sorted(bytes(r.data) for r in whole.collect()) == sorted((t or "").encode() for _, t, *_ in ODD)


def test_token_digest_of_a_leading_space(frame, pair):
    texts = [" abc", " ", " abc de", "  abc", "abc"]
    for r in bpe.round_trip(frame([(i, t, "en", "s") for i, t in enumerate(texts)])).collect():
        ids = pair[1].encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()), texts[r.doc_id]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<!-- ad --><div class="ad">Buy this now and for ever, dear reader.</div>%s<footer>&copy; x &middot; y</footer></body></html>"""


@pytest.mark.parametrize("body,expected", [
    ("<article><h1>Head</h1><p><b>First of   all &amp; more&lt;<br><p>One.</p><ul><li>a b c</li></ul><p>Last</p></article>", "Head\nFirst of all & more<\nOne.\na b c\nLast"),
    ("<div class=content><h1>Big news &eacute;</h1><p>First para of the article is here with a lot of words in it.<p>Second one. <script>x<y</script>Ok <!-- no --> then.<div class='advertisement'>Buy this now</div><p>End.</div><div class=sidebar><ul><li><a href=1>Link</a></ul></div><div id=comments><p>I really love this article and want to say so.</p></div>",
     "Big news é\nFirst para of the article is here with a lot of words in it.\nSecond one. Ok then.\nEnd."),
    ("<div class='main has-sidebar'><div class='content-sidebar-wrap'><h1 class='page-header'>Title of it</h1><p>The first paragraph has enough words to be one of the text.</p><p>So has the second paragraph, which is here as well.</p></div><div class='sidebar-left'><p>Links and more links of all kinds are here.</p></div></div>",
     "Title of it\nThe first paragraph has enough words to be one of the text.\nSo has the second paragraph, which is here as well."),
    ("<main><p>Text &notin; x &#x41;&#66; &unknown; &nbsp; end of it.</p><form>Mail <input></form><aside><p>Related things that are long enough to look like text.</p></aside><p>More.</p></main>", "Text ∉ x AB &unknown; end of it.\nMore."),
])
def test_main_text(spark, body, expected):
    got = html_mss.main_text(spark.createDataFrame([(1, "u", PAGE % body, "x")], "page_id long, url string, html string, text string")).first()
    assert (got.page_id, got.url, got.text, got.n_chars) == (1, "u", expected, len(expected))


LONG = "The text of the page goes on for quite a while here and has more than twelve words in it."


@pytest.mark.parametrize("page,expected", [
    (f"<html><head><title>T</title><p>{LONG}</p><p>Second one.</p></html>", f"{LONG}\nSecond one."),  # no end of head
    (f"<html><head><title>T</title>{LONG}", LONG),
    (f'<body><nav><a href="/">a</a></nav><div class="post tag-menu"><h1>Title here</h1><p>{LONG}</p></div></body>', f"Title here\n{LONG}"),
    (f'<body><div class="post category-social"><p>{LONG}</p></div></body>', LONG),
    (f'<body><div class="entry print"><h1>Title</h1><p>{LONG}</p><div class="ad">buy this now</div><p>More of it.</p></div></body>', f"Title\n{LONG}\nMore of it."),
    (f'<body><article><h3>Read on</h3><p>Short teaser of another page.</p></article><div><h1>Title</h1><p>{LONG * 4}</p><p>{LONG}</p></div></body>', f"Title\n{LONG * 4}\n{LONG}"),
    (f'<body><form id="aspnet"><h1>Title</h1><p>{LONG}</p></form></body>', f"Title\n{LONG}"),
    (f'<body><div id="content"><h1>Title</h1><p>{LONG}</p></div><div id="comments">' + "<p>I think that this is bad or good</p>" * 20 + "</div></body>", f"Title\n{LONG}"),
    (f"<body><div><p>{LONG}</p></div>" + "<div></div>" * 500 + "<div><p>Text far away, without any name.</p></div></body>", LONG),  # every tag costs
    (f"<body><main><h1>Title</h1><h3>Part one</h3><p>{LONG}</p><h4>Part two</h4><p>{LONG}</p></main></body>", f"Title\nPart one\n{LONG}\nPart two\n{LONG}"),
    (f'<body><div><p>{LONG}</p></div><div><a href="/x">Next page</a> <a href="/y">Print</a></div></body>', LONG),  # only the scan can tell
])
def test_region(page, expected):
    assert "\n".join(html_mss.main_blocks(page)) == expected


def test_region_is_the_best_of_all():
    rnd = random.Random(9)
    for _ in range(400):
        n = rnd.randint(0, 12)
        words, tags = [rnd.randint(-9, 9) for _ in range(n)], [-rnd.randint(0, 5) for _ in range(n)]
        lo, hi = html_mss.best_region(words, tags)
        assert sum(words[lo:hi]) + sum(tags[lo + 1 : hi]) == brute.best_region(words, tags)[0]


def test_scan_decides_on_composed_pages():
    right = decided = blocks = 0
    pages = html_mss.labelled_pages()
    for parts in pages:
        page = "".join(x for x, _ in parts)
        truth = [b.text for x, main in parts if main for b in html_mss.blocks_of(x)[0]]
        stream, _, _ = html_mss.scored(page)
        got = html_mss.main_blocks(page)
        decided += len(got) < len(stream)
        blocks += max(len(truth), len(got))
        right += sum((Counter(truth) & Counter(got)).values())
    assert decided > 0.2 * len(pages) and right > 0.93 * blocks, (decided, len(pages), right, blocks)


def test_odd_pages(spark):
    odd = [None, "", "  ", "<", "<p", "plain text only", "<a href='x", "&lt;b&gt; &am &amp x", "<!-- unclosed", "<script>x", "<p>" * 3000, "<" * 50_000, "<div class='ad'>only an advert here</div>", "x" * 300_000, "</p></div>a b c"]
    got = html_mss.main_text(spark.createDataFrame([(i, None, h) for i, h in enumerate(odd)] * 2, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 2 * len(odd) and all(r.n_chars == len(r.text) for r in got)
    assert text[0] == text[1] == text[2] == "" and text[5] == "plain text only" and text[7] == "<b> &am & x" and text[12] == "" and len(text[13]) == 300_000
