"""Host consensus extraction, dual-tree search and whitening against brute force and small fixtures."""

import math
import re
from collections import Counter
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from runlake.llm import extraction, lexical, whitening
from runlake.llm.oracle import ORACLE_SQL
from runlake.llm.queries import QUERIES

SF, BIGGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---------------------------------------------------------------- extraction
class Article(HTMLParser):
    """Blocks of the article element, by the standard parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.inside &= tag != "footer"
        if tag in ("p", "h1", "li", "div", "ul", "h2", "pre"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("p", "h1", "li", "div", "ul", "h2", "pre"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_given_pages_equal_their_articles(spark):
    pages = spark.read.parquet(f"{BIGGER}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = rows(QUERIES["op11_host_consensus"](spark, BIGGER))
    assert len(got) == len(html)
    for r in got:
        expected = "\n\n".join(b for b in (" ".join(x.split()) for x in Article(html[r["page_id"]] or "").blocks) if b)
        assert r["text"] == expected and r["n_chars"] == len(expected)


PARTS = {
    "menu": "<div class='main-menu'><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></div>",
    "header": "<header><h1>Site name</h1></header>",
    "side": "<div class=sidebar><p>Sidebar words that are long enough to look like a paragraph of text.</p></div>",
    "notice": "<div id=cookieNotice><p>We use cookies.</p></div>",
    "advert": "<div class='box ad-slot'>Buy now</div>",
    "form": "<form><label>Mail</label><input><button>Go</button></form>",
    "remarks": "<section id=comments><article class=comment><p>" + "A reader says many words here. " * 20 + "</p></article></section>",
    "footer": "<footer>End &copy;</footer>",
}


def test_parts_that_are_not_the_article():
    for shell in ("<article>{}</article>", "<div class='entry-content x12'>{}</div>", "<main><div class=q7>{}</div></main>"):
        inner = "<h1>Title &amp; more</h1>" + PARTS["advert"] + "<p>First  <b>bold</b>er\n text.<p>Second &lt;x&gt;<br>line." \
            + PARTS["notice"] + "<ul><li>One<li>Two</ul><script>if (a < b) '</p>'</script><style>p{}</style>"
        page = "<html><body class='has-sidebar'>" + PARTS["menu"] + PARTS["header"] + shell.format(inner) + PARTS["side"] \
            + PARTS["form"] + PARTS["remarks"] + PARTS["footer"]
        read = extraction.Page(page, {})
        assert read.text([read.best()]) == "Title & more\n\nFirst bolder text.\n\nSecond <x> line.\n\nOne\n\nTwo", shell


def test_a_form_around_the_whole_page_is_read():
    page = "<body><form id=aspnet><div class='page-header'>Head</div><div id=content><h1>T</h1><p>Some text.</p></div></form>"
    read = extraction.Page(page, {})
    assert read.text([read.best()]) == "T\n\nSome text."


@pytest.mark.parametrize("limit", [extraction.BROADCAST_BYTES, 0])
def test_the_host_outvotes_a_page(spark, monkeypatch, limit):
    monkeypatch.setattr(extraction, "BROADCAST_BYTES", limit)
    body = "<div class=c{k}><p>" + "Main words. " * 12 + "</p></div><div class=x><p>" + "{extra}" + "</p></div>"
    pages = [(k, "http://H.example/p", "<body>" + body.format(k=k, extra="Short.")) for k in range(9)]
    pages.append((9, "http://h.example/q", "<body>" + body.format(k=9, extra="Other words here. " * 5)))
    pages.append((10, "http://h.example/q", "<body><pre>Another template.</pre>"))
    pages += [(11, None, None), (12, "none", ""), (12, "none", ""), (None, "http://h.example/", "<b>x"), (13, None, "a \u00a0 b")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns(
        {"host": F.lit(1), "paths": F.lit(2), "text": F.lit("t"), "path": F.lit("p"), "votes": F.lit(3), "salt": F.lit(4)})
    got = rows(extraction.main_texts(df))
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages)
    assert all(texts[k] == ("Main words. " * 12).strip() for k in range(10))
    assert texts[10] == "Another template." and texts[11] == texts[12] == "" and texts[None] == "x" and texts[13] == "a b"
    assert extraction.main_texts(df.limit(0)).count() == 0


def test_broken_and_very_long_pages_take_linear_time():
    for page in ("<div>" * 50_000 + "x", "<p><b>x" * 50_000, '<a href="' * 50_000, "<li><b>x</div>" * 50_000, "<!-- " * 50_000,
                 "<script>" + "</script " * 50_000, "<p " + "a" * 1_000_000 + " x=1>t", "word " * 4_000_000):
        read = extraction.Page(page, {})
        read.text([read.best()])
    assert read.text([read.best()]).count("word") == 4_000_000


# ---------------------------------------------------------------- lexical search
def brute_ranking(docs, items, k=20):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    bags = [(d, Counter(term.findall((t or "").translate(low)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 100 - 25 + (25 * sum(b.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 12 * m))
                    for t in term.findall((text or "").translate(low)) if t in b)
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [lexical.ITEM_BLOCK_BYTES, 300])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "ITEM_BLOCK_BYTES", block)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["\u00c9t\u00e9", "a\u00e9B", "UPPER", "upper", "\u4e2d\u6587"]
    text = lambda m: " -,".join(rng.choice(vocabulary, m)) + "."
    docs = [(i, text(int(rng.integers(1, 30)))) for i in range(400)] + [(i, "w1 w2 w3") for i in range(400, 460)]
    docs += [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, "w1 w2 w3"), (500, None), (501, ""), (502, " .- "), (503, "w5 " * 20_000)]
    items = [(i, text(int(rng.integers(1, 12)))) for i in range(30)] + [(30, "w1 w2 w3 w1"), (31, None), (32, ""), (33, "zzz"),
                                                                        (5, "w9 w9"), (None, "w8"), (34, "w4 " * 5_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns(
        {c: F.lit(1) for c in ("n", "at", "tf", "part", "item", "score", "rank", "item_no", "block", "size")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumns(
        {c: F.lit(1) for c in ("item_no", "block", "size", "doc_id", "score")})
    got = sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in lexical.ranked(d, q).collect()), key=repr)
    assert got == brute_ranking(docs, items)


def test_search_of_nothing(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for docs, items in ((d.limit(0), q), (d, q.limit(0)), (d.withColumn("text", F.lit(None).cast("string")), q)):
        made = lexical.ranked(docs, items)
        assert made.count() == 0 and made.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_prune_whole_pairs():
    """Items and documents in four topics: most leaf pairs are never scored, and the best are still found."""
    rng = np.random.default_rng(5)
    wanted = [{int(t): 1 for t in rng.choice(50, 5, replace=False) + 50 * (i % 4)} for i in range(32)]
    weights = np.full(200, 1000)
    tree = lexical.ItemTree(wanted, weights, 200)
    levels, best = tree.levels(), lexical.Best(32, 3, np.zeros(32, np.int64))
    sets = sorted(sorted((rng.choice(50, 8, replace=False) + 50 * (i // 100)).tolist()) for i in range(400))
    at = np.concatenate([np.array(s) for s in sets])
    ends = np.cumsum([len(s) for s in sets])
    scored, possible = lexical.search_batch(best, tree, levels, [tree.leaf(k) for k in range(len(levels[0]))], list(range(400)),
                                            at, np.full(len(at), 500.0), ends)
    assert scored < possible / 2
    for i, w in enumerate(wanted):
        every = sorted(((-500_000 * len(set(w) & set(s)), d) for d, s in enumerate(sets) if set(w) & set(s)))[:3]
        assert [(s, d) for s, _, d in sorted(best.found[i])] == every


def test_search_oracle_on_more_documents(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{BIGGER}/{t}.parquet'")
    expected = sorted(con.execute(ORACLE_SQL["op12_dual_tree_search"]).fetchall())
    got = QUERIES["op12_dual_tree_search"](spark, BIGGER).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == expected


# ---------------------------------------------------------------- whitening
def brute_whitening(vectors, components):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in vectors
            if v and all(c is not None and math.isfinite(c) for c in v)]
    lists = np.array(sorted({tuple(x) for _, x in kept}), dtype=np.int64)
    n, sums = len(lists), lists.sum(0)
    centred = lists - sums / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(values)[::-1][:components]
    out = {}
    for i, x in kept:
        deviation = sum((n * a - int(b)) ** 2 for a, b in zip(x, sums))
        y = (np.array(x) - sums / n) @ basis[:, order] / np.sqrt(values[order])
        out.setdefault(i, []).append((n, deviation, y, values[order] / values.sum()))
    return out


def same_up_to_sign(got, want):
    """Components have one sign for all rows."""
    for c in range(want.shape[1]):
        sign = np.sign(got[:, c] @ want[:, c])
        np.testing.assert_allclose(got[:, c] * sign, want[:, c], rtol=1e-7, atol=1e-8)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_equals_a_dense_solver(spark, parts):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    extra = [(-1, None), (-2, [None] * 64), (-3, [float("nan")] * 64), (-4, [float("inf")] * 64), (-5, []), (-6, [1.0] * 3),
             (-7, vectors[0][1]), (None, vectors[1][1]), (-7, vectors[0][1])]
    names = {c: F.lit(1) for c in ("x", "n", "component", "deviation", "size", "count")}
    df = spark.createDataFrame(vectors + extra, "vec_id long, embedding array<float>").repartition(parts).withColumns(names)
    got = rows(whitening.whiten(df, 16))
    want = brute_whitening(vectors + [e for e in extra if e[1] and len(e[1]) == 64], 16)
    assert len(got) == 16 * (len(vectors) + 3)
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), r)
        assert r["identity_error"] < 1e-9
    ids = list(want)
    assert {k[0] for k in by} == set(ids)
    for i in ids:
        n, deviation, _, share = want[i][0]
        for c in range(16):
            r = by[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["explained"] - share[c]) < 1e-9 * share[c]
    same_up_to_sign(np.array([[by[i, c + 1]["whitened"] for c in range(16)] for i in ids]), np.array([want[i][0][2] for i in ids]))


def test_whitening_of_flat_and_empty_tables(spark):
    flat = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(flat).count() == 0 and whitening.whiten(flat.limit(0)).count() == 0
    line = spark.createDataFrame([(i, [i / 8, i / 4, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = rows(whitening.whiten(line))
    assert {r["component"] for r in got} == {1} and len(got) == 9 and abs(got[0]["explained"] - 1) < 1e-12


@pytest.mark.parametrize("kind", ["plain", "copies", "axis", "scales", "repeated"])
def test_rank_one_updates_and_merges_keep_the_spectrum(kind):
    rng = np.random.default_rng(11)
    x = {"plain": rng.integers(-30, 30, (200, 24)), "copies": np.repeat(rng.integers(-9, 9, (20, 24)), 10, 0),
         "axis": np.repeat(np.eye(24, dtype=np.int64), 5, 0) * 7, "scales": rng.integers(-9, 9, (200, 24)) * 10 ** (np.arange(24) % 5),
         "repeated": np.repeat(rng.integers(-5, 5, (200, 12)), 2, 1)}[kind].astype(np.int64) + whitening.SHIFT
    whole, other = whitening.Spectrum(24), whitening.Spectrum(24)
    whole.add(x[:80])
    other.add(x[80:])
    whole.merge(whitening.Spectrum.read({k: v[0] for k, v in other.row(0).items()}))
    c = x - x.mean(0)
    scatter = c.T @ c
    top = np.abs(scatter).max()
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - scatter).max() < 1e-10 * top
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(24)).max() < 1e-10
    assert whole.n == len(x) and (whole.sums == x.sum(0)).all()
