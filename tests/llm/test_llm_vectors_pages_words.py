"""Whitening, main text and spelling variants against plain versions, on small tables with nulls, ties and repeats."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tremorlake.llm import embedding_whitening, html_extraction, spelling_variants

VECTORS = "vec_id long, embedding array<float>, label int, n long, x string"


def exact_fit(grid):
    """Count, sums and covariance of the different rows of ``grid`` in whole numbers."""
    different = sorted(set(map(tuple, grid)))
    n, d = len(different), len(different[0])
    total = [sum(r[k] for r in different) for k in range(d)]
    centred = np.array([[n * r[k] - total[k] for k in range(d)] for r in different], dtype=object)
    return n, total, (centred.T @ centred).astype(float) / n**3


def test_whitening_equals_whole_numbers(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 6)) @ r.normal(size=(6, 6))
    rows = [(k, [float(v) for v in b], 0, 9, "x") for k, b in enumerate(base)]
    # A vector that a third of all rows hold, one that differs below the grid, a null id, and rows that are left out.
    rows += [(100 + k, rows[0][1], 0, 9, "x") for k in range(40)] + [(None, rows[1][1], 0, 9, "x"), (300, [v + 1e-9 for v in rows[2][1]], 0, 9, "x")]
    out = [(400, None, 0, 9, "x"), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 9, "x"), (402, [float("nan")] * 6, 0, 9, "x"), (403, [float("inf")] * 6, 0, 9, "x"), (404, [], 0, 9, "x")]
    frame = spark.createDataFrame(rows + out, VECTORS).repartition(7)
    got = embedding_whitening.whiten(frame).collect()
    grid = {k: [int(np.floor(64 * float(np.float32(v)))) + 1_000_000 for v in b] for k, b, *_ in rows}
    n, total, v = exact_fit(grid.values())
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 6 * len(rows) and {x["vec_id"] for x in got} == {k for k, *_ in rows}
    signs = {}
    for x in sorted(got, key=lambda x: (x["vec_id"] is None, x["vec_id"], x["component"])):
        c, g = x["component"] - 1, grid[x["vec_id"]]
        assert x["n"] == n and x["deviation"] == sum((n * a - s) ** 2 for a, s in zip(g, total, strict=True))
        want = sum((n * a - s) / n * w for a, s, w in zip(g, total, axes[:, c], strict=True)) / values[c] ** 0.5
        signs.setdefault(c, np.sign(want) * np.sign(x["whitened"]))
        assert x["whitened"] == pytest.approx(signs[c] * want, abs=1e-9) and x["explained"] == pytest.approx(values[c] / np.trace(v), rel=1e-9)
        assert x["identity_error"] < 1e-9
    assert embedding_whitening.whiten(frame.where("FALSE")).count() == 0


def test_whitening_of_lengths_and_flat_vectors(spark):
    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=20).tolist(), 0, 0, "") for k in range(50)] + [(100 + k, [1.0, float(k % 3)], 0, 0, "") for k in range(9)] + [(200, [3.0e38, -3.0e38, 1.0], 0, 0, ""), (201, [0.0, 0.0, 2.0], 0, 0, "")]
    got = embedding_whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    by = {}
    for x in got:
        by.setdefault(x["vec_id"], []).append(x)
    assert len(by) == len(rows) and len(by[0]) == 16 and len(by[100]) == 2 and len(by[200]) == 3
    flat = {x["component"]: x for x in by[100]}
    assert flat[2]["whitened"] == 0 and flat[2]["explained"] == 0 and flat[1]["n"] == 3
    assert all(x["deviation"] is None for x in by[200]) and all(x["identity_error"] < 1e-6 for x in got)
    alone = embedding_whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "")], VECTORS)).collect()
    assert [(x["whitened"], x["deviation"], x["explained"], x["identity_error"]) for x in alone] == [(0, 0, 0, 0)] * 2


def test_chan_merging_in_any_order():
    x = np.random.default_rng(5).integers(999_000, 1_001_000, (500, 5))
    parts = [{5: embedding_whitening.own(p)} for p in np.array_split(x, 13)]
    whole = embedding_whitening.own(x)
    for order in (parts, parts[::-1], sorted(parts, key=lambda p: p[5][0])):
        at = {}
        for p in order:
            at = embedding_whitening.merged(at, p)
        n, mean, scatter, total = at[5]
        assert n == 500 and total == x.sum(0).tolist() == whole[3]
        np.testing.assert_allclose(mean, x.mean(0), rtol=1e-14)
        np.testing.assert_allclose(scatter, np.cov(x.T, bias=True) * 500, rtol=1e-10, atol=1e-4)


def test_cut_is_the_least_of_all():
    r = np.random.default_rng(6)
    for _ in range(120):
        blocks, inner = int(r.integers(1, 7)), int(r.integers(0, 3))
        n = blocks + inner
        capacity = [float(c) for c in r.integers(-20, 21, blocks) / 8]
        edges = [(int(a), int(b), float(r.integers(0, 12)) / 8) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]

        def cost(side):
            return sum(abs(c) for c, s in zip(capacity, side, strict=False) if s != (c > 0)) + sum(c for a, b, c in edges if side[a] != side[b])

        found = html_extraction.cut(capacity, n, edges)
        best = min(cost(side) for side in itertools.product([False, True], repeat=n))
        # Nodes without a terminal that were left out of a settled graph take the better side.
        assert min(cost((*found[:blocks], *rest)) for rest in itertools.product([False, True], repeat=inner)) == pytest.approx(best)


PAGES = {
    "": "",
    "  \n ": "",
    "just a few words": "just a few words",
    "<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>A &amp; B<p>C\n  &lt;d&gt;<div class='ad-slot'>x</div><aside>y</aside><form><p>mail <input></form></article><section id=comments><article><p>A reader says much about this.</article></section></main><div class='cookie-notice'>We use cookies</div>": "T\nA & B\nC <d>",
    "<body class='has-sidebar'><div id='leftSidebar'><p>A long text stands here, and nobody wants to read any of it.</p></div><div class='post-content'><p>Short.<p>So.</div><footer>(c) 2020 Foo</footer>": "Short.\nSo.",
    "<form id=f><div class=menu><a href=x>m</a></div><article>Hello<br>there</article></form>": "Hello there",
    "<article><p>One<b>two<p>three <i>f</i>our<script>var x='</p>'; if (a<b)</script> end<ul><li>a<li>b</ul><style>p{}</style><!-- no --></article><p class=notice>n</p>": "Onetwo\nthree four end\na\nb",
    "<article><p title='a>b'>x</p><p>1 < 2 & 3</p><table><tr><td>c<td>d<tr><td>e</table>": "x\n1 < 2 & 3\nc d\ne",
    "<div><a href=x>Home</a> <a href=y>About us</a></div><div><h2>Title</h2><p>This paragraph has a good many words and says something about the world at large.</p><p>Yes.</p><p>Here are more words that a reader would like to read, and they end with a stop.</p></div><div><a href=z>Next page</a></div><div>© 2024 Foo. All rights reserved.</div>": "Title\nThis paragraph has a good many words and says something about the world at large.\nYes.\nHere are more words that a reader would like to read, and they end with a stop.",
    "<article>" + "<div>" * 3000 + "deep" + "</p>" * 3000 + "</article><nav>x</nav>": "deep",
    "<article>" + "<p>word &eacute; w" * 20000: "\n".join(["word é w"] * 20000),
}


def test_main_text(spark):
    rows = [(k, f"http://h/{k}", page, "t", 1) for k, page in enumerate(PAGES)] + [(None, None, None, "t", 1), (3, "http://h/3", list(PAGES)[3], "t", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = [(x["page_id"], x["url"], x["text"], x["n_chars"]) for x in html_extraction.extract(pages).collect()]
    want = [(i, u, PAGES.get(page, ""), len(PAGES.get(page, ""))) for i, u, page, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert html_extraction.extract(pages.where("FALSE")).count() == 0


def test_main_text_of_the_pages_table(spark):
    """The article's blocks, taken out by a pattern that knows these pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {x["page_id"]: x["text"] for x in html_extraction.extract(pages).collect()}
    from html import unescape

    for x in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", x["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))]
        assert texts[x["page_id"]] == "\n".join(b for b in blocks if b)


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {w: [o for o in n if o != w and one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark):
    r = np.random.default_rng(7)
    stems = ["".join(map(chr, r.choice([*range(97, 103), 0xE9, 0xDF], int(k)))) for k in r.integers(5, 12, 60)] + ["x" * 70, "abcdefghij" * 6]

    def damaged(w):
        at, c = int(r.integers(0, len(w))), chr(int(r.choice([97, 98, 0xE9])))
        return [w, w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w.upper()][int(r.integers(0, 5))]

    rows = [(k, " ".join(damaged(stems[min(int(r.exponential(9)), len(stems) - 1)]) for _ in range(60)), "c", 1) for k in range(120)]
    rows += [(7, "plank " * 30 + "planks-" * 10 + "plankss " * 4, "c", 1), (None, "Chain 12chain_Ünïcode×÷ünïcode", "c", 1), (5, None, "c", 1), (6, "", "c", 1)] + [rows[0]] * 3
    rows += [(900 + k, "aaaaa " * 3**k + "aaaab " * 2, "c", 1) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(5)
    got = {(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling_variants.spelling_variants(docs).collect()}
    want = plain_variants([(x["doc_id"], x["text"]) for x in docs.collect()])
    assert got == want and len(want) > 150 and sum(x[4] for x in want) > 300 and ("plankss", "planks", "plank") in {x[:3] for x in want}
    assert spelling_variants.spelling_variants(docs.where("FALSE")).count() == 0


def test_spelling_variants_of_the_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect()]
    # The plain version compares all words with all.
    rows = rows[:40]
    got = {(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling_variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_variants(rows)
