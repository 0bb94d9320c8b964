import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.fixtures import EDGES, documents, words
from tracefold.llm import decontaminate, htmltext, licenses, linededup, mixing, quality, sharding, voronoi

# line dedup


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_patience_matches_equal_lines_in_order(a, b):
    m = linededup.patience(a, b)
    assert all(a[i] == b[j] for i, j in m)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))
    if a == b:
        assert len(m) == len(a)


def dedup_by_hand(rows, rare):
    lines = {i: [x.strip() for x in t.split("\n")] if t else [] for i, t in rows if i is not None}
    holders = {}
    for i in sorted(lines):
        for x in set(lines[i]) - {""}:
            holders.setdefault(x, []).append(i)
    code = {x: k + 1 for k, x in enumerate(holders)} | {"": 0}
    out = {}
    for i, mine in lines.items():
        gone = set()
        for x in set(mine) - {""}:
            h = holders[x]
            if len(h) > rare and h[0] != i:
                gone |= {k for k, y in enumerate(mine) if y == x}
            elif h[0] != i:
                gone |= set(linededup.common_blocks([code[y] for y in lines[h[0]]], [code[y] for y in mine]))
        out[i] = gone
    return out


def test_moved_blocks_go_by_a_later_alignment():
    """The blank line of a moved block goes with it, a blank line between own lines stays."""
    assert linededup.common_blocks([1, 2, 3], [3, 9, 1, 8, 2]) == [0, 2, 4]
    assert linededup.common_blocks([1, 0, 2, 3, 0, 4], [3, 0, 4, 9, 0, 8, 1, 0, 2]) == [0, 1, 2, 6, 7, 8]
    start = time.time()
    assert len(linededup.common_blocks(list(range(1, 20_001)), list(range(20_000, 0, -1)))) == 20_000
    assert time.time() - start < 20


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignments_leave_no_shared_line(a, b):
    gone = set(linededup.common_blocks(a, b))
    assert {j for j in gone if b[j]} == {j for j, x in enumerate(b) if x and x in a}


def test_lines_match_a_plain_version(spark):
    r = random.Random(7)
    pool = [f"line {k} of the pool" for k in range(60)]
    rows = [(i, "\n".join(r.choice(pool) if r.random() < 0.4 else r.choice(["", f"own {i} {j}", " common line "])
                          for j in range(r.randrange(1, 15))), "s") for i in range(80)]
    got = linededup.dedup_lines(documents(spark, rows), rare=6).collect()
    want = dedup_by_hand([(i, t) for i, t, _ in rows], 6)
    texts = {i: t.split("\n") if t else [] for i, t, _ in rows}
    for x in got:
        assert x.n_removed == len(want[x.doc_id]) and x.n_lines == len(texts[x.doc_id])
        assert x.text == "\n".join(t for k, t in enumerate(texts[x.doc_id]) if k not in want[x.doc_id])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.sampled_from([1, 20, 1 << 28]))
def test_longest_common_subsequence(a, b, cells):
    old, linededup.LCS_CELLS = linededup.LCS_CELLS, cells
    try:
        m = linededup.longest_common(a, b)
    finally:
        linededup.LCS_CELLS = old
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(m) == best[-1][-1] and all(a[i] == b[j] for i, j in m)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def test_no_anchor_is_needed():
    assert linededup.common_blocks([9, 1, 0, 2, 1, 0, 2, 8], [7, 1, 0, 2, 5, 1, 0, 2, 6]) == [1, 2, 3, 5, 6, 7]
    assert linededup.common_blocks([1, 2, 3], [4, 3, 5, 2, 2, 0]) == [1, 3, 4]


def test_lines_go_however_many_documents_hold_them(spark):
    """Repeated in a document, out of order, blank between: the same for 2, 64 and 65 holders."""
    rows = []
    for k, holders in enumerate((2, 64, 65)):
        rows += [(1000 * k, f"x{k}\na{k}\n\nb{k}\nc{k}\na{k}\ny{k}", "s")]
        rows += [(1000 * k + i, f"own {k} {i}\ny{k}\na{k}\n\nb{k}\nc{k}\na{k}\nmore {k} {i}", "s") for i in range(1, holders)]
    got = {r.doc_id: r for r in linededup.dedup_lines(documents(spark, rows)).collect()}
    for i, t, _ in rows:
        if i % 1000:
            assert got[i].text == f"own {i // 1000} {i % 1000}\nmore {i // 1000} {i % 1000}" and got[i].n_removed == 6
        else:
            assert got[i].text == t


def test_line_edges(spark):
    df = documents(spark, [*EDGES, (7, "one\n\nnew", "a"), (8, "one", "a")])
    out = linededup.dedup_lines(df)
    assert set(df.columns) < set(out.columns)
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.n_removed) for r in out.filter("doc_id <> 5 or doc_id is null").collect() if r.text is not None)
    assert (7, "\nnew", 3, 1) in got and (8, "", 1, 1) in got and got.count((4, "one", 1, 0)) == 2
    assert (0, "no id", 1, 0) in got
    assert out.filter("text IS NULL").collect()[0].n_lines == 0
    assert linededup.dedup_lines(documents(spark, [])).count() == 0

# exact top-k


def top_by_hand(rows, k, every):
    sound = [(i, [int(np.floor(float(x) * 256)) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in sound if i % every == 0}:
        qv = max(v for i, v in sound if i == q)
        scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in sound if i != q and len(v) == len(qv))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "DATA_BLOCK", 20)
    monkeypatch.setattr(voronoi, "QUERY_BLOCK", 3)
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + r.gauss(0, 0.05) for c in centres[i % 5]]) for i in range(400)]
    rows += [(i, centres[0]) for i in range(1000, 1100)]                  # ties
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (2150, [float("inf")] + [0.0] * 5),
             (None, [1.0] * 6), (2200, []), (2201, []), (2250, [1.0, 2.0]), (-50, [0.5] * 6)]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, cell int, rank int")
    got = {tuple(x) for x in voronoi.top_products(df, k=5, every=50).collect()}
    assert got == top_by_hand(rows, 5, 50)


@pytest.mark.parametrize("size", [2.0 ** 22, 2.0 ** 27, 1e9, 1.7e308])
def test_top_products_of_large_components(spark, size):
    """Beyond what doubles and longs hold, products are exact, or given as the bound of long and ranked exactly."""
    r = random.Random(6)
    rows = [(i, [size * r.choice([1.0, -1.0, 0.5]) + r.randrange(9) / 256, r.gauss(0, 1)]) for i in range(120)]
    rows += [(200, [size, size / 2]), (250, [size / 4, 1 / 3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")

    def whole(x):
        return math.floor(256 * x) if abs(256 * x) < 2 ** 53 else int(max(min(256 * x, 1.7976931348623157e308), -1.7976931348623157e308))
    want, bound = set(), 2 ** 63 - 1
    for q, v in rows:
        if q % 50 == 0:
            scores = [(sum(whole(a) * whole(b) for a, b in zip(v, w)), i) for i, w in rows if i != q]
            want |= {(q, k + 1, i, max(-bound, min(bound, s))) for k, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:5])}
    assert {tuple(x) for x in voronoi.top_products(df).collect()} == want


def test_top_products_prunes_cells(spark):
    """Well-parted cells: a query is sent to a few only."""
    r = random.Random(4)
    rows = [(i, [20.0 * (j == i % 8) + r.gauss(0, 0.01) for j in range(8)]) for i in range(800)]
    data = voronoi.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    pivots = voronoi.choose_pivots(data, 8)
    celled = data.mapInArrow(voronoi._assign(pivots, 50), voronoi._CELLED)
    cells = voronoi.summaries(celled, 5)
    routes = celled.filter("query").select("vec_id", "vec").mapInArrow(
        voronoi._route(pivots, cells, 5), "query_id long, cell int").count()
    assert routes < celled.filter("query").count() * len(cells) / 3


def test_top_products_empty(spark):
    assert voronoi.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0

@pytest.mark.parametrize("names", [("_s", "_start", "_id", "_cell", "rate"), ("id_0", "gone_0", "hot_0", "row", "of")])
def test_columns_of_the_caller_keep_their_values(spark, names):
    rows = [(i, f"line {i % 3}\nown {i}", "a", *[7 + k for k in range(5)]) for i in range(20)] + [(None, None, None, *[7] * 5)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    mixed = mixing.mix_sources(df, added=False)
    assert mixed.columns == df.columns and {tuple(r) for r in mixed.collect()} <= set(rows)
    for got in (sharding.assign_shards(df, 3), linededup.dedup_lines(df)):
        assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in got.collect()) == sorted((str(r[0]), *r[3:]) for r in rows)

# main text


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header>Site</header>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>&nbsp;text<br>goes  on<p>Second &lt;one&gt;
<div class="share">Share</div><form><input><button>Send</button></form><ul><li>item</ul>
<section class="comments"><p>Reader</p></section></article><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    assert htmltext.Page(PAGE).text() == "Title & more\nFirst bold text goes on\nSecond <one>\nitem"


def test_main_and_plain_body():
    assert htmltext.Page("<main><p>a</main><p>b").text() == "a"
    assert htmltext.Page("<div><p>a</div>b <i>c</i> < d<p").text() == "a\nb c < d"
    assert htmltext.Page(None).text() == "" and htmltext.Page("<!-- x").text() == ""
    assert htmltext.Page("<p>a<script>if (a < b) '</p>'</SCRIPT>b<style>x").text() == "ab"


def test_names_inside_articles():
    """Inside an article a class word alone marks nothing, a whole marking name does."""
    page = ('<article><section class="related-work">one</section><div class="share-price">two</div>'
            '<div class="share-buttons">x</div><div id=comments>no</div>' + "<p title=Bob's>it's</p><p>end</p></article>")
    assert htmltext.Page(page).text() == "one\ntwo\nit's\nend"
    assert htmltext.Page('<div class="share-price">x</div><p>a').text() == "a"


def test_text_beside_a_teaser():
    page = "<article><p>teaser</article><div class=content><h1>Title</h1><p>The text itself, much longer</div>"
    assert htmltext.Page(page).text() == "teaser\nTitle\nThe text itself, much longer"
    assert htmltext.Page(page.replace("teaser", "a text that is longer than all that stands beside it")).text() \
        == "a text that is longer than all that stands beside it"


@pytest.mark.parametrize("part, more", [
    ('<a "', ""), ('<a b="', ""), ("<!", ""), ("<!--", ""), ("</script ", "<script>"), ("<div>t", ""), ("</x>", "<div>" * 100_000),
    ("<li></li>", "<li><ul>" + "<b>" * 100_000), ("<h1>x</h1>", "<b>" * 100_000), ("<xmp>", ""), ("x ", "<a "), ("&#x00", "")])
def test_a_megabyte_of_broken_markup_takes_seconds(part, more):
    start = time.time()
    page = htmltext.Page(more + part * (1_000_000 // len(part)))
    page.text({(1, 1)}), page.main_text()
    assert time.time() - start < 30
    assert len(page.content) <= len(page.nodes)


def test_style_tree_removes_what_repeats(spark):
    rows = [(i, f"http://Host{i % 2}.example/p{i}", f"<body><div class=top>Welcome to us</div><div class=text><p>Own text {i}</p></div>"
             f"<div class=x{i}><p>Always the same</p></div></body>", i) for i in range(40)]
    rows += [(100 + i, "http://one.example/", "<p>copy</p>", 1) for i in range(20)]           # copies count once
    rows += [(200, None, None, 1), (201, "x", "", 1), (None, "y", "<p>z", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in htmltext.extract_text(df).collect()}
    assert got[3].text == "Own text 3" and got[3].n_chars == 10
    assert got[105].text == "copy" and got[200].text == "" and got[201].n_chars == 0 and got[None].text == "z"
    assert htmltext.extract_text(df.limit(0)).count() == 0


def test_repetition_leaves_near_copies_and_unique_texts(spark):
    """A text that most pages of a host share stays, on them and beside unique ones; what stands beside texts goes."""
    same = "The same long report stands on most pages of this host, word for word. " * 3
    forms = {"a": "<body><div class=top>Menu {i}</div><article><div class=body><p>{t}</p></div></article>",
             "b": "<body><div class=top><p>On day {i}</div><div class=x><p>{t}</p><ul><li>{t}</ul></div>",
             "c": "<body><div class=wrap><main><section>{t}</section></main></div>{i}",
             "d": "<body><div class=y><p>{t}</p></div><div class=end><p>Bottom line</p></div>"}
    rows = [(1000 * k + i, f"http://{h}.example/{i}", form.format(i=i, t=same if i < 36 else f"Own text {i} " * 20))
            for k, (h, form) in enumerate(forms.items()) for i in range(40)]
    rows += [(9000 + i, "http://e.example/", f"<body><div><p>{'Bottom text' if i < 36 else 'My bottom'}</p></div><pre>Text {i} of its own</pre>")
             for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract_text(df).collect()}
    for i in range(40):
        text = same.strip() if i < 36 else (f"Own text {i} " * 20).strip()
        assert got[i] == got[2000 + i] == text
        assert got[1000 + i] == f"On day {i}\n{text}\n{text}"
        assert got[3000 + i].split("\n")[0] == text
        assert got[9000 + i] == ("" if i < 36 else "My bottom\n") + f"Text {i} of its own"

# decontamination


def test_leaks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WORDS_AT_ONCE", 300)
    monkeypatch.setattr(decontaminate, "PIECES_A_PASS", 12)
    items = [(k, " ".join(words(k, 15 + 7 * k)) + ". The answer is " + f"w{k} x{k} y{k}.", 0) for k in range(20)]
    items += [(50, None, 0), (51, "", 0), (52, " ! ", 0), (None, "void item", 0), (3, items[3][1], 0)]
    r, rows, want = random.Random(2), [], set()
    for i in range(120):
        w = words(10_000 + i, r.choice([5, 90, 700]))
        if i % 3 == 0:
            k = r.randrange(20)
            leak = items[k][1].upper().replace(".", " ;").split()
            for _ in range(len(leak) // 20):
                leak[r.randrange(len(leak))] = "changed"
            at = r.randrange(len(w))
            w[at:at] = leak
            want.add((i, k))
        rows.append((i, " ".join(w), "s"))
    df = documents(spark, [*rows, (500, None, "s"), (501, "", "s"), (None, "a b", "s")])
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id int")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(df, bench).collect()} == want
    clean = decontaminate.drop_leaks(df, bench)
    assert clean.columns == df.columns
    assert {x.doc_id for x in clean.collect()} == {x.doc_id for x in df.collect()} - {i for i, _ in want}
    assert decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0


def test_all_pieces_above_the_threshold_are_retrieved():
    """Block-max bounds never hide a piece that scoring everything finds."""
    r = random.Random(1)
    rows = [(k, 0, w, 3, 0.0) for k in range(30) for w in sorted(set(words(k, 20, 120)))]
    count = {}
    for x in rows:
        count[x[0]] = count.get(x[0], 0) + 1
    df = {w: sum(x[2] == w for x in rows) for _, _, w, _, _ in rows}
    rows = [(k, p, w, df[w], 1 / count[k]) for k, p, w, _, _ in rows]
    index = decontaminate.Index(rows, {k: " ".join(words(k, 20, 120)) for k in range(30)})
    texts = [words(900 + i, r.randrange(0, 400), 120) for i in range(20)]
    for text, got in zip(texts, index.retrieve(texts)):
        want = {}
        for p in range(0, max(1, len(text)), decontaminate.HALF):
            for k in range(30):
                s = sum(x[4] for x in rows if x[0] == k and x[2] in set(text[p:p + 2 * decontaminate.HALF]))
                if s >= decontaminate.LEAST_SCORE:
                    want[k] = max(want.get(k, 0), s)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)

# quality


def rated(n):
    r, rows, grades = random.Random(8), [], []
    for i in range(n):
        w, g = words(i, r.randrange(20, 200)), r.choice([0, 1, 2, 2, 2])
        if g == 0:
            w = [x.upper() + "!!" for x in w]
        if g == 1:
            for _ in range(2 + len(w) // 40):
                w[r.randrange(len(w))] = r.choice(["nasty", "vile", "horrid"])
        rows.append((i, " ".join(w), "s"))
        grades.append((i, g, "x"))
    return rows, grades


def test_held_out_grades(spark):
    rows, grades = rated(900)
    df = documents(spark, rows)
    ratings = spark.createDataFrame(grades, "doc_id long, grade int, text string")
    model = quality.fit_grades(df, ratings.filter("doc_id < 600"))
    assert model[1] == sorted(model[1]) and len(model[1]) == 2
    truth = dict(g[:2] for g in grades)
    held = [x for x in quality.grade_documents(df, model).collect() if x.doc_id >= 600]
    right = sum(x.selected == (truth[x.doc_id] == 2) for x in held)
    assert right / len(held) > 0.97
    mean = [np.mean([x.expected_grade for x in held if truth[x.doc_id] == g]) for g in range(3)]
    assert mean == sorted(mean)
    kept = quality.select_documents(df, model)
    assert kept.columns == df.columns
    assert {x.doc_id for x in kept.collect() if x.doc_id >= 600} == {x.doc_id for x in held if x.selected}


def test_quality_edges(spark):
    df = documents(spark, EDGES)
    none = spark.createDataFrame([(1, None), (2, 1), (None, 0)], "doc_id long, grade int")
    model = quality.fit_grades(df, none)
    assert model == ({}, [])
    assert all(r.selected for r in quality.grade_documents(df, model).collect())
    rows, grades = rated(200)
    model = quality.fit_grades(documents(spark, rows), spark.createDataFrame(grades, "doc_id long, grade int, x string"))
    assert quality.grade_documents(df, model).count() == len(EDGES)
    assert quality.grade_documents(df.limit(0), model).count() == 0


def test_scores_equal_the_sum_of_features():
    r = np.random.default_rng(0)
    weights = {int(b): float(r.normal()) for b in range(quality.BUCKETS) if r.random() < 0.5}
    for text in ("", "A a a a!! THE the, théâtre théâtres", "x " * 50):
        ids, values = quality.Featurizer()(text)
        assert abs(quality.Scorer(weights)(text) - sum(weights.get(int(i), 0) * float(v) for i, v in zip(ids, values))) < 1e-5

# licences


def test_licence_lines(spark):
    said = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
            "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "all-rights-reserved",
            "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    r, rows, want = random.Random(6), [], set()
    for i in range(300):
        lines = [" ".join(words(i * 50 + j, r.randrange(3, 30))) for j in range(r.randrange(1, 6))]
        if i % 4 == 0:
            line = r.choice(sorted(said))
            at = r.randrange(len(lines) + 1)
            lines.insert(at, f"  {line} ")
            want.add((i, at, said[line]))
        rows.append((i, "\n".join(lines), "s"))
    df = documents(spark, [*rows, *[(1000, *e[1:]) if e[0] is None else (e[0] + 2000, *e[1:]) for e in EDGES]])
    got = licenses.scan_licenses(df).collect()
    assert {(x.doc_id, x.pos, x.family) for x in got if x.confirmed} == want
    plan = licenses.scan_licenses(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scan_licenses(documents(spark, [])).count() == 0
