"""HTML text, token counts and decontamination."""

import random

import numpy as np
import pytest
from conftest import ODD_TEXTS, docs_of

from kasaflow.llm import decontam, html_text, token_counts
from kasaflow.llm.catalog import queries

P = pytest.importorskip("public_tokenizers")
SP = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.Vocabulary(P.path(token_counts.MODEL))


@pytest.fixture(scope="module")
def library():
    return SP.SentencePieceProcessor(model_file=P.path(token_counts.MODEL))


def test_counts_equal_the_library_on_made_up_texts(vocabulary, library):
    rng = random.Random(1)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "▁", "é", "日", "\t", "😀", "<s>", "</s>", "<0x41>", "aa", "the the",
             "ll", "0", "　", "e", "r", "n", "t", "\x00", "ß", "ñ", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, " " * 300, "ab" * 3000, " x" * 100, "", "".join(rng.choices("abcdefghijklmnop", k=4000))]
    assert token_counts.count_tokens(texts, vocabulary, {}) == [len(x) for x in library.encode(texts)]


def test_counts_do_not_depend_on_cache_or_batch(vocabulary, library, monkeypatch):
    texts = [f"some words {i} and others\nmore {i % 7}" for i in range(300)]
    want = [len(x) for x in library.encode(texts)]
    monkeypatch.setattr(token_counts, "CACHE_UNITS", 20)
    monkeypatch.setattr(token_counts, "UNITS_AT_ONCE", 7)
    cache, got = {}, []
    for k in range(0, 300, 50):
        got += token_counts.count_tokens(texts[k:k + 50], vocabulary, cache)
    assert got == want


def test_token_query_equals_the_library(spark, sf, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries()["op6_token_counts"](spark, sf).collect():
        assert r.n_tokens == len(library.encode(docs[r.doc_id])) and r.over_limit == (r.n_tokens > 4096)
        assert r.n_bytes == len(docs[r.doc_id].encode())


def test_token_counts_of_odd_texts(spark, library):
    got = token_counts.with_token_counts(docs_of(spark, ODD_TEXTS, extra=True), P.path(token_counts.MODEL)).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.doc_id)] == [len(library.encode(t or "")) for t in ODD_TEXTS]


PAGES = [
    ("<p>One<p>Two <b>bold</b>  x", "One\n\nTwo bold x"),
    ("<ul><li>a<li>b<ol start=3><li>q<li>r</ol><li>c</ul>tail", "- a\n- b\n  3. q\n  4. r\n- c\n\ntail"),
    ("<table><tr><th>Name<th>N<tr><td>longer<td>1<tr><td colspan=2>span</table>", "Name    N\nlonger  1\nspan"),
    ("<pre>  a\n   b</pre>x", "  a\n   b\n\nx"),
    ('<div style="display: none">no</div><span hidden>no</span>yes<script>if(a<b)no</script><style>no</style>', "yes"),
    ("<head><title>no</title></head><body>yes<!-- no --><template>no</template></body>", "yes"),
    ("a<br>b &amp; c < d &copy;", "a\nb & c < d ©"),
    ("<dl><dt>term<dd>meaning<dt>next</dl>", "term\n  meaning\nnext"),
    ("<div>a</div><div>b</div><h1>H</h1>c", "a\nb\n\nH\n\nc"),
    ("<td>loose</td><li>item", "loose\n- item"),
    ("text <a href='x>y'>link</a> <unclosed", "text link <unclosed"),
    ("<blockquote>said<p>twice</blockquote>", "  said\n\n  twice"),
    ("<select><option>x<option>y</select>", "x\ny"),
    ("<table><caption>C</caption><tr><td><ul><li>a<li>b</ul><td>z</table>", "C\n- a  z\n- b"),
    ("", ""), (None, ""), ("   ", ""), ("<<<>>>", "<<<>>>"), ("&#233;&nbsp;&lt;b&gt;", "é <b>"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_layout(html, text):
    assert html_text.page_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<head><title>T</title>Some text<br>more<p>x", "Some text\nmore\n\nx"),
    ("<head><meta charset=x>\n<textarea>kept</textarea>", "kept"),
    ("<head><title>T</title><xmp><b></xmp>", "<b>"),
    ("<head><title>T</title><br>a", "a"),
    ("<head><title>T</title><input type=submit value=Go>", "Go"),
    ("<head>&nbsp;a", "\xa0a"),
    ("<head><title>T</title><![CDATA[a]]>", "a"),
    ("<head>\n<script>no</script> <noscript>no</noscript><template>no</template><link><title>T</title>\n</head>yes", "yes"),
])
def test_an_open_head_ends_where_the_body_begins(html, text):
    assert html_text.page_text(html).lstrip("\n") == text


def test_deep_nesting_keeps_all_text():
    n = 3000
    words = [f"w{i}" for i in range(n)]
    got = html_text.page_text("".join(f"<div>{w} " for w in words) + "<textarea>last</textarea>" + "</div>" * n)
    assert got.split() == words + ["last"]


def test_every_visible_word_of_the_pages_survives(spark, sf):
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries()["op5_html_text"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        bare = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->", " ", pages[r.page_id])
        from html import unescape
        want = unescape(re.sub(r"<[^>]*>", " ", bare)).split()
        got = [w for w in r.text.split() if w != "-"]
        assert "".join(got) == "".join(w for w in want if w != "-"), r.page_id
        assert r.n_chars == len(r.text)


def test_pages_with_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "<p>x", "old"), (None, "u", None, None), (1, None, "<p>x", "old")],
                               "page_id long, url string, html string, k string")
    got = html_text.with_text(df).orderBy("text").collect()
    assert [r.text for r in got] == ["", "x", "x"] and got[1].k == "old"


# ---- decontamination ------------------------------------------------------------


def _words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 5))) for _ in range(n)]


def _edit_distance(a, b):
    """Of a to the best stretch of b, row by row."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_distances_equal_plain_dynamic_programming():
    rng = random.Random(4)
    items = [" ".join(_words(i, rng.randint(5, 12))) for i in range(20)]
    bench = decontam.Benchmark(list(range(20)), items)
    from kasaflow.llm.textarrays import WORD_BYTES, Flat
    for k, item in enumerate(items):
        other = _words(100 + k, 6) + [w for w in item.split() if rng.random() < 0.8] + _words(200 + k, 4)
        flat = Flat([" ".join(other).encode()])
        words = flat.hashes(*flat.runs(WORD_BYTES))
        d, _ = decontam.distances(bench, np.array([k]), words, np.array([0]), np.array([len(words)]))
        assert d[0] == _edit_distance(item.split(), other)


def test_recall_and_no_false_hits():
    rng = random.Random(3)
    items = [_words(i, rng.randint(12, 60)) for i in range(60)]
    bench = decontam.Benchmark(list(range(60)), [" ".join(w) for w in items])
    texts, want = [], []
    for j in range(300):
        k = rng.randrange(60)
        w = list(items[k])
        for _ in range(int(decontam.edits(len(w)))):
            p, how = rng.randrange(len(w)), rng.random()
            if how < 0.34:
                w[p] = "zq"
            elif how < 0.67:
                del w[p]
            else:
                w.insert(p, "qz")
        before = _words(1000 + j, 80)
        texts.append(" ".join(before[:40] + w + before[40:]))
        want.append(k)
    got = decontam.leaks(bench, texts)
    assert np.mean([any(x[0] == k for x in g) for g, k in zip(got, want)]) >= 0.95
    assert all(x[1] <= decontam.edits(x[2]) for g in got for x in g)
    for g, t in list(zip(got, texts))[:40]:  # what is reported is the exact distance
        for item, dist, n, _ in g:
            assert dist == _edit_distance(items[item], t.split())
    assert sum(map(len, decontam.leaks(bench, [" ".join(_words(5000 + j, 300)) for j in range(100)]))) == 0


def test_exact_copies_are_always_found(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if t and x in t}
    got = {(r.doc_id, r.item_id) for r in queries()["op3_decontamination"](spark, sf).collect()}
    assert want and want <= got


def test_odd_items_and_texts(spark):
    df = docs_of(spark, ODD_TEXTS + ["Word!", "a b c d", "a b c d e"], extra=True)
    items = spark.createDataFrame([(1, None), (2, ""), (3, "word"), (4, "A b, c d."), (None, "word"), (6, "a b c d x")],
                                  "item_id long, text string")
    def found(**how):
        rows = decontam.with_leaks(df, items, column="found", **how).collect()
        return {r.doc_id: sorted((x.item_id for x in r.found), key=str) for r in rows if r.found}
    assert found() == {3: [3, None], 10: [3, None], 11: [4, 6], 12: [4, 6]}
    assert found(every_item=False) == {3: [3], 10: [3], 11: [4, 6], 12: [6]}
    assert decontam.with_leaks(df, items.where("false")).where("size(leaks) > 0").count() == 0
    assert decontam.with_leaks(df.where("false"), items).count() == 0


def test_every_item_is_found_inside_longer_texts(spark, tmp_path):
    import corpus_pipeline
    zh, th = "床前明月光疑是地上霜举头望明月低头思故乡", "ภาษาไทยเขียนติดกันโดยไม่เว้นวรรค"
    texts = ["long before: Deep blue SEA, and after", "前文很长" + zh + "，后面还有", "ก่อนหน้า" + th + "และต่อไป", "il a dit «un deux trois quatre cinq» hier",
             "deep blue", "nothing of it", "a nameless passage of seven words stands here", None, "deep blue sea deep blue sea"]
    docs = docs_of(spark, texts)
    items = spark.createDataFrame([(1, "deep blue sea"), (2, zh), (3, th), (4, "un deux trois quatre cinq"), (2 ** 60 + 1, "Sea"),
                                   (None, "nameless passage of seven words"), (None, "hier")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = queries()["op3_decontamination"](spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.item_id, r.distance) for r in rows}
    sea = 2 ** 60 + 1
    assert len(rows) == len(got) == 9
    assert got == {(0, 1, 0), (0, sea, 0), (1, 2, 0), (2, 3, 0), (3, 4, 0), (3, None, 0), (6, None, 0), (8, 1, 0), (8, sea, 0)}
    assert {(r.item_words, r.word_end) for r in rows if r.doc_id in (0, 8) and r.item_id == 1} == {(3, 5), (3, 3)}
    left = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in left) == [4, 5, 7]


# ---- pages and texts that used to stop a task or hold it for hours ------------------------------------

@pytest.mark.parametrize("html,text", [
    ('<ol start="--5"><li>a', "1. a"), ('<ol start="²"><li>a', "1. a"), ('<ol start="-3"><li>a<li>b', "-3. a\n-2. b"),
    ('<ol start=" +7px"><li>a<li>b', "7. a\n8. b"), ('<ol start=""><li>a', "1. a"), ("<ol start><li>a", "1. a"),
    ('<table><tr><td colspan="²">x<td>y', "x  y"), ('<table><tr><td colspan="-2">x<td>y', "x  y"),
    ('<table><tr><td rowspan="x">x<td>y<tr><td>zz<td>w', "x   y\nzz  w")])
def test_malformed_numbers_stand_for_the_default(html, text):
    assert html_text.page_text(html) == text


def test_numbers_of_thousands_of_digits_are_limited():
    digits = "9" * 5_000
    assert html_text.page_text(f'<ol start="{digits}"><li>a').endswith(". a")
    line = html_text.page_text(f'<table><tr><td colspan="{digits}">x<td rowspan="{digits}">y<tr><td>z</table>')
    assert line.split() == ["x", "y", "z"] and len(line) < 5_000


def test_cells_of_several_rows_keep_their_columns():
    assert html_text.page_text("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>") == "A  b\n   c\nd  e"
    assert html_text.page_text("<table><tr><td>aa<td rowspan=3 colspan=2>B<td>c<tr><td>d<td>e<tr><td>f<td>g</table>") \
        == "aa  B   c\nd       e\nf       g"
    # 0: to the end of the part; the next part begins with all columns free
    assert html_text.page_text("<table><thead><tr><td rowspan=0>A<td>b<tr><td>c</thead><tbody><tr><td>d<td>e</table>") == "A  b\n   c\nd  e"


def test_hidden_and_closing_elements_count_beyond_any_depth():
    deep = "<div>" * (html_text.DEPTH + 10)
    assert html_text.page_text(deep + "<div hidden>SECRET<b>SECRET</b></div>seen") == "seen"
    assert html_text.page_text(deep + "<script>SECRET</script><span style='display:none'>SECRET</span>seen<template>x") == "seen"
    assert html_text.page_text("<p>a<em>" + "<i>" * 200 + "b" + "</i>" * 200 + "</em><p>c") == "ab\n\nc"
    assert html_text.page_text("<div hidden>" + "<div>" * 300 + "SECRET" + "</div>" * 300 + "</div>seen") == "seen"


def test_deep_and_open_markup_stays_linear():
    import time
    start = time.time()
    assert html_text.page_text("<p><button>" + "<div>" * 50_000 + "x").endswith("x")
    assert html_text.page_text("<table><tr><td>" * 20_000 + "y").count("y") == 1
    assert len(html_text.page_text("<div><span>t" * 20_000).split()) == 20_000
    assert time.time() - start < 20


def test_a_page_of_malformed_numbers_among_others(spark):
    pages = spark.createDataFrame([(1, '<ol start="--5"><li>a'), (2, None), (3, "<td colspan='²' rowspan=1e9>x")], "page_id long, html string")
    assert {r.page_id: r.text for r in html_text.with_text(pages).collect()} == {1: "1. a", 2: "", 3: "x"}


@pytest.fixture(scope="module")
def pieces():
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path(token_counts.MODEL)
    return token_counts.Vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_runs_of_blanks_of_every_length(pieces):
    vocabulary, library = pieces
    assert vocabulary.blanks > 1
    texts = [" " * k for k in range(1, 300)] + [f"{' ' * k}word{' ' * (k // 2)}\n{' ' * k}-" for k in range(1, 300)]
    assert token_counts.count_tokens(texts, vocabulary, {}) == [len(library.encode(t)) for t in texts]


def test_long_runs_take_no_time(pieces):
    import time
    vocabulary, library = pieces
    texts = [" " * 1_000_000, "a" * 100_000, "\t" * 100_000, "=-" * 50_000, "中文" * 50_000, (" " * 5_000 + "x") * 100, "▁" * 50_000, "\xa0" * 50_000]
    want = [len(library.encode(t)) for t in texts]
    for t, n in zip(texts, want):
        start = time.time()
        assert token_counts.count_tokens([t], vocabulary, {}) == [n], t[:4]
        assert time.time() - start < 10


def test_merges_from_the_queue_equal_the_library(pieces, monkeypatch):
    import random
    vocabulary, library = pieces
    rng = random.Random(11)
    texts = ["".join(rng.choice(["ab", "the", "ing", "é", "x1", "-", "--", "▁", "中", chr(rng.randint(33, 0x2FF))]) for _ in range(rng.randint(50, 400)))
             for _ in range(150)]
    want = [len(library.encode(t)) for t in texts]
    for steps in (0, 3, token_counts.STEPS):
        monkeypatch.setattr(token_counts, "STEPS", steps)
        assert token_counts.count_tokens(texts, vocabulary, {}) == want


def test_long_units_are_not_kept(pieces):
    cache = {}
    token_counts.count_tokens(["x" * 10_000 + " word"], pieces[0], cache)
    assert all(len(u) <= token_counts.CACHE_LETTERS for u in cache) and " word" in cache


# ---- benchmark items: equal ones, blocks, recall by length -------------------------------------------

def test_equal_items_cost_what_one_does_and_all_get_their_rows():
    import time
    rng = random.Random(21)
    passage = " ".join(f"w{rng.randint(0, 500)}" for _ in range(25))
    texts = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(300)) + " " + passage for _ in range(5)]
    one = decontam.Benchmark([0], [passage])
    many = decontam.Benchmark(list(range(20_000)), [passage] * 10_000 + [passage.upper() + "!"] * 10_000)
    start = time.time()
    want = decontam.leaks(one, texts)
    single = time.time() - start
    start = time.time()
    got = decontam.leaks(many, texts)
    assert time.time() - start < 10 * single + 2
    for w, g in zip(want, got):
        assert len(g) == 20_000 and {x[0] for x in g} == set(range(20_000)) and {x[1:] for x in g} == {w[0][1:]}


def test_many_blocks_and_passes_find_the_same(spark, monkeypatch):
    rng = random.Random(22)
    items = [" ".join(f"w{rng.randint(0, 80)}" for _ in range(rng.choice([2, 4, 6, 9, 20]))) for _ in range(40)]
    rows = [(None if k % 9 == 0 else k, t) for k, t in enumerate(items + items[:3])]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    docs = docs_of(spark, ODD_TEXTS + [" ".join(rng.choices(["x", "y", *items], k=12)) for _ in range(30)])

    def found():
        got = decontam.with_leaks(docs, bench).select("doc_id", "leaks").collect()
        return {r.doc_id: sorted(map(tuple, r.leaks), key=repr) for r in got}
    whole = found()
    monkeypatch.setattr(decontam, "ITEMS_AT_ONCE", 4)
    monkeypatch.setattr(decontam, "BLOCKS_AT_ONCE", 2)
    assert found() == whole and sum(map(len, whole.values())) > 50


@pytest.mark.parametrize("words", [5, 6, 7, 8, 9, 10, 11])
def test_recall_of_short_items_with_as_many_edits_as_allowed(words):
    rng = random.Random(words)
    hits = n = 0
    for _ in range(60):
        item = [f"k{rng.randint(0, 9999)}" for _ in range(words)]
        planted = list(item)
        for at in rng.sample(range(words), int(decontam.edits(words))):
            planted[at] = "changed"
        text = " ".join([f"w{rng.randint(0, 300)}" for _ in range(60)] + planted + [f"w{rng.randint(0, 300)}" for _ in range(60)])
        hits += bool(decontam.leaks(decontam.Benchmark([1], [" ".join(item)]), [text])[0])
        n += 1
    assert hits / n >= 0.9


def test_very_long_text_with_a_passage_at_its_end():
    rng = random.Random(23)
    passage = " ".join(f"k{i}" for i in range(30))
    text = " ".join(f"w{rng.randint(0, 3000)}" for _ in range(300_000)) + " " + passage
    found = decontam.leaks(decontam.Benchmark([7], [passage]), [text])[0]
    assert [(x[0], x[1], x[3]) for x in found] == [(7, 0, 300_030)]
