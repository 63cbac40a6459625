"""Language models, page extraction, near-duplicates and the pipeline."""

import random
import re
import string
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import html_labels, html_text, langid, minhash
from weft.plans.components import connected_components


def _text(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def test_kneser_ney_sums_to_one():
    rng = random.Random(1)
    model = langid.fit_model({"a": [_text(rng, "abcd", 30) for _ in range(20)], "b": [_text(rng, "bcde", 30) for _ in range(20)]})
    words, sums = [""], [np.exp(model.log_probs([""])).sum(0)]
    for _ in range(7):
        words = [w + c for w in words for c in "abcde"]
        sums.append(np.exp(model.log_probs(words)).sum(0))
    # Probabilities of all words make up one: those up to seven characters, and a tail that falls geometrically.
    ratio = sums[-1] / sums[-2]
    assert np.allclose(sum(sums) + sums[-1] * ratio / (1 - ratio), 1, atol=0.02)


def test_language_id(spark, docs):
    rng = random.Random(2)
    kinds = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "opqrstu"}
    rows = [(i, _text(rng, kinds[g], 40), "s", g) for i, g in enumerate(sorted(kinds) * 60)]
    rows += [(1000, None, "s", "aa"), (1001, "", "s", "aa"), (1002, "12 34 ½", "s", None), (None, _text(rng, "opqrstu", 40), "s", "cc"), (1003, "ABAB CDEF " * 4000, "s", None)]
    table = docs(rows)
    model = langid.learn(table)
    got = {r.doc_id: r for r in langid.identify(table, model).collect()}
    right = [got[i].lang_pred == g for i, _, _, g in rows[:180]]
    assert np.mean(right) > 0.97
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows if i is not None)
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[None].lang_pred == "cc" and got[1003].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    gibberish = docs([(1, "жшщ ъыь эюя " * 20), (2, rows[0][1]), (3, None)])
    kept = langid.keep_identified(gibberish, model)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == gibberish.columns
    assert langid.identify(docs([]), langid.learn(docs([]))).count() == 0
    assert langid.identify(docs([(1, "no model")]), langid.learn(docs([]))).first().lang_pred == "und"


def test_held_out_rows_teach_nothing(spark, docs):
    import zlib

    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert langid.learn(docs([(i, "abc def", "s", "xx") for i in out])).langs == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div>%s<footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        (PAGE % "<article><h1>A  &amp;\n B</h1><p>One <b>two</b><br>three<p>four&nbsp;x &#233;</article>", "A & B\nOne two\nthree\nfour x é"),
        (PAGE % "<article><header><h1>Title</h1></header><p>Some words of the text.</p><aside>No</aside><form>No<input></form></article>", "Title\nSome words of the text."),
        (PAGE % '<article><p>Some words of the text.</p><div class="comments"><p>First!</p></div></article>', "Some words of the text."),
        (PAGE % "<article><p>Broken off here", "Broken off here"),
        ("<article><p>a < b and c</p><!-- no --><p>d</p></article>", "a < b and c\nd"),
        ("<body><div id=main><p>" + "word " * 50 + "</p></div></body>", ("word " * 50).strip()),
        ("just text, no tags at all", "just text, no tags at all"),
        (PAGE % ("<p>" + "word " * 30 + "</p><ul><li>one two</li><li>three</li></ul><p>" + "word " * 20 + "</p>"), "\n".join([("word " * 30).strip(), "one two", "three", ("word " * 20).strip()])),
        (PAGE % ("<p>" + "word " * 30 + "</p><table><tr><td>a</td><td>b</td></tr></table><p>" + "word " * 20 + "</p>"), "\n".join([("word " * 30).strip(), "a", "b", ("word " * 20).strip()])),
        (PAGE % '<article><p class="share-price">The price of a share fell.</p><p class="related-work">Others wrote of it before.</p></article>', "The price of a share fell.\nOthers wrote of it before."),
        (PAGE % "<article><p>Some words of the text.</p><label>A side note of it</label><p>More words of the text.</p></article>", "Some words of the text.\nA side note of it\nMore words of the text."),
    ],
)
def test_extract(page, text):
    assert html_text.extract(page) == text


def _plain_extract(page, by):
    """Every run is tried; blocks are scored one by one from sets of features."""
    items = list(html_text.read(page, html_text._Features()))
    block = lambda x: isinstance(x, html_text.Block)
    weight = [max(-html_text.LARGEST, min(html_text.LARGEST, by.bias + sum(by.words.get(f, 0) for f in {*x.around, *x.own}))) if block(x) else 0 for x in items]
    score = [x.n * w if block(x) else by.tags.get(x, min(by.tags.values()) / 2) for x, w in zip(items, weight, strict=True)]
    best = max(((sum(score[i:j]), -i, j) for i in range(len(items)) for j in range(i + 1, len(items) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return ""
    own = range(-best[1], best[2])
    good = [i for i in own if weight[i] > 0]
    kept = [items[i].text for i in own if block(items[i]) and not (good[0] < i < good[-1] and weight[i] < html_text.CUT)]
    return "\n".join(filter(None, (" ".join(line.split()) for t in kept for line in t.split("\n"))))


def test_extraction_equals_brute_force():
    by = html_text.model()
    for page in html_labels.labelled_pages(60, seed=5):
        page = page.replace(html_labels.MARK, "")
        assert html_text.extract(page, by).split() == _plain_extract(page, by).split()


@pytest.mark.parametrize("element", [True, False])
def test_extraction_of_held_out_labelled_pages(element):
    hit = got = want = 0
    for page in html_labels.labelled_pages(300, seed=7, element=element):
        marked = Counter(re.findall(html_labels.MARK + r"([^\s<]+)", page))
        found = Counter(html_text.extract(page.replace(html_labels.MARK, "")).split())
        hit, got, want = hit + sum((marked & found).values()), got + sum(found.values()), want + sum(marked.values())
    assert 2 * hit / (got + want) > 0.97


def test_extraction_is_linear():
    for part in ("<article>", '<article class="a"><p>x y z</article>', "<iframe><p", "<b></i></p>", "<title>", '<p "'):
        start = time.monotonic()
        html_text.extract(part * 20_000)
        assert time.monotonic() - start < 10


def test_best_run_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        s = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        best = max([(sum(s[i:j]), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)], default=(0, 0))
        a, b = html_text.best_run(s)
        assert sum(s[a:b]) == max(best[0], 0)


def test_pages(spark):
    rows = [(1, "u", PAGE % "<article><p>Hello there.</p></article>"), (2, None, None), (None, "v", "x" * 200_000), (1, "u", "<p>again and again</p>")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))
    assert html_text.extract_pages(table.limit(0)).count() == 0
    got = html_text.extract_pages(table).collect()
    assert sorted((r.n_chars for r in got)) == [0, 12, 15, 200_000] and all(r.n_chars == len(r.text) for r in got)


def _components(rows, size, similarity=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    own = sorted(sets)
    for i, a in enumerate(own):
        for b in own[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(5))
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    for _ in range(25):  # families with edits, chains among them
        w = [word() for _ in range(60)]
        for _ in range(rng.randint(1, 5)):
            add(w)
            w = list(w)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = word()
    base = [word() for _ in range(80)]
    for _ in range(60):  # a large group whose members are often further apart than the threshold
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        add(w)
    passage = [word() for _ in range(20)]
    for _ in range(40):
        add([word() for _ in range(40)] + passage + [word() for _ in range(40)])
    for _ in range(30):
        add(base)
    rows += [(1000, "one two"), (1001, "ONE  two"), (1002, ""), (1003, None), (1004, " \n"), (1005, "É a b c d"), (1006, "é a b c d")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs([*rows, (None, "one two"), rows[3]]), size=4).collect()}
    assert got.pop(None) == (1, None, True)
    assert got == _components(rows, 4)
    assert minhash.near_duplicates(docs([])).count() == 0
    kept = {r.doc_id for r in minhash.keep_first(docs(rows), size=4).collect()}
    assert kept == {d for d, (_, _, k) in _components(rows, 4).items() if k}


def test_keep_first_tells_rows_apart_by_id_and_text(spark, docs):
    rng = random.Random(7)
    text = lambda: _text(rng, "abcdefgh", 60)
    a, b, c, d, e = (text() for _ in range(5))
    near = f"{a} end"
    rows = [(1, a), (5, near), (5, b)]  # one id, two texts: the near-copy goes, the other stays
    rows += [(7, c, "s1"), (7, c, "s1"), (7, c, "s0"), (8, c)]  # repeated rows: one stays
    rows += [(9, ""), (9, ""), (9, None), (9, None), (10, "")]  # without words: one of each id and text
    rows += [(11, d), (11, f"{d} end")]  # near-copies under one id: one stays
    rows += [(None, e), (None, e), (None, a)]  # null ids: all stay
    table = docs(rows)
    out = minhash.keep_first(table)
    assert out.dtypes == table.dtypes
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    mine = [x for x in got if x[0] == 11]
    assert len(mine) == 1 and mine[0][1] in (d, f"{d} end")
    want = [(1, a), (5, b), (7, c), (9, ""), (9, None), (10, ""), (None, e), (None, e), (None, a)]
    assert [x for x in got if x[0] != 11] == sorted(want, key=repr)
    assert [r.source for r in out.where("doc_id = 7").collect()] == ["s0"]


def test_fewest_is_the_posterior():
    rng = np.random.default_rng(0)
    for n in (16, 64, 112):
        m = minhash.fewest(n, 80, 1e-3)
        draws = rng.beta(m, n - m + 2, 400_000)  # one fewer than kept: posterior under the bound
        assert (draws >= 0.8).mean() < 2e-3
        assert (rng.beta(m + 1, n - m + 1, 400_000) >= 0.8).mean() > 5e-4


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(500, 500), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = defaultdict(lambda: None)
    want |= {i: 0 for i in range(51)} | {i: 100 for i in range(100, 160)} | {500: 500, 200: 200, 201: 200}
    assert got == dict(want)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontaminate", "pack"]
    now, seen = table, set()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        ids, before = {r.doc_id for r in out.select("doc_id").collect()}, {r.doc_id for r in now.select("doc_id").collect()}
        assert ids <= before
        if name != "pack":
            assert out.columns == table.columns
        else:
            assert ids == before
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in now.collect()]
            assert ids == {d for d, (_, _, k) in _components(rows, 5).items() if k}
        if name in ("near_dedup", "decontaminate"):
            seen |= before - ids
        now = out
    assert seen
    assert corpus_pipeline.run(spark, sf).count() == now.count()


def test_stages_on_odd_rows(spark, docs):
    import corpus_pipeline

    rng = random.Random(6)
    rows = [(i, _text(rng, "abcdefgh", 60), None if i % 3 else "s", None if i % 2 else "aa") for i in range(12)]
    rows += [rows[0], (None, None), (20, None), (21, ""), (22, " \n \n"), (None, rows[1][1]), (23, _text(rng, "abcdefgh", 9000)), (24, "12 34"), (25, "a")]
    for table in (docs(rows), docs([])):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, "/root/testdata/sf0.001")
            got = out.collect()
            if name != "pack":
                assert out.columns == table.columns
                now = spark.createDataFrame(got, table.schema)
        if rows and table.take(1):
            assert {p.doc_id for p in got} >= {*range(1, 12), 23} and {20, 21, 24}.isdisjoint({p.doc_id for p in got})
