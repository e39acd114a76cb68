"""Operators over embeddings and pages against brute force, and on odd rows."""

import re
from collections import Counter

import numpy as np

from tests.conftest import SF

VEC = "vec_id long, embedding array<float>, label int, id long, bucket int"


def planted(spark, n=1_200, dim=24, seed=0):
    """Groups around centres with cosines on both sides of 0.9, exact copies, and odd rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            x = rng.normal(size=dim)
        else:
            c = np.random.default_rng(1_000 + i % 37).normal(size=dim)
            x = c + rng.normal(size=dim) * rng.choice([0.05, 0.2, 0.33, 0.45])
        rows.append([i, [float(np.float32(v)) for v in x], 0, 1, 2])
    for i in range(60):
        rows.append([n + i, rows[7][1], 0, 1, 2])
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] + [0.0] * (dim - 1), [1.0, 2.0]]
    rows += [[n + 100 + i, x, 0, 1, 2] for i, x in enumerate(odd)] + [[None, rows[0][1], 0, 1, 2]]
    return rows, spark.createDataFrame(rows, VEC)


def test_hamming_tables_against_brute_force(spark, monkeypatch):
    from precis.llm import itq
    monkeypatch.setattr(itq, "BLOCK", 32)
    rows, vectors = planted(spark)
    got = {r.vec_id: r for r in itq.near_duplicates(vectors).collect() if r.vec_id is not None}
    good = [(i, x) for i, x, *_ in rows if i is not None and i < 1_260]
    ids, m = np.array([i for i, _ in good]), np.array([x for _, x in good], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    links = (m @ m.T >= 0.9).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in ids])
    assert (found <= links).all() and found.sum() / links.sum() >= 0.97
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1_300, 1_307))
    comp = {i: got[i].component_id for i in ids}
    assert all(comp[c] == c and c <= i for i, c in comp.items())
    assert len(got) == 1_267


def test_hamming_tables_on_the_table(spark):
    from precis.llm.itq import near_duplicates
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = near_duplicates(vectors).collect()
    x = np.array([r.embedding for r in vectors.orderBy("vec_id").collect()], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert sum(r.n_links for r in rows) == (x @ x.T >= 0.9).sum() - len(x)
    assert near_duplicates(vectors.limit(0)).count() == 0


def brute_top_k(rows, k, step):
    dim = max(len(x) for _, x in rows)
    ids = np.array([i for i, _ in rows])
    z = np.array([[np.floor(64 * v) for v in x] + [0.0] * (dim - len(x)) for _, x in rows])
    out = []
    for n, q in enumerate(ids):
        if q % step == 0:
            s = z @ z[n]
            other = np.flatnonzero(np.arange(len(ids)) != n)
            best = other[np.lexsort((ids[other], -s[other]))][:k]
            out += [(int(q), r + 1, int(ids[i]), int(s[i])) for r, i in enumerate(best)]
    return sorted(out)


def test_top_k_is_exact(spark, monkeypatch):
    from precis.llm import norm_topk
    monkeypatch.setattr(norm_topk, "BUCKET", 100)
    monkeypatch.setattr(norm_topk, "CHUNK", 16)
    rows, vectors = planted(spark)
    scaled = spark.createDataFrame([(i, [v * (1 + i % 11) for v in x] if x and i is not None and None not in x else x, 0, 1, 2)
                                    for i, x, *_ in rows], VEC)
    usable = [(r.vec_id, r.embedding) for r in scaled.collect() if r.vec_id is not None and r.embedding is not None
              and None not in r.embedding and np.isfinite(r.embedding).all()]
    for steep in (0.8, 0.05):                    # mostly length pruning, mostly coordinate pruning
        monkeypatch.setattr(norm_topk, "STEEP", steep)
        got = norm_topk.top_k(scaled, lambda i: i % 20 == 0, k=20)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top_k(usable, 20, 20)


def test_top_k_small_and_empty(spark):
    from precis.llm.norm_topk import top_k
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(few, lambda i: i % 20 == 0).collect())
    assert got == brute_top_k([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 0.0])], 20, 20)
    assert top_k(few.limit(0), lambda i: i % 20 == 0).count() == 0
    assert top_k(few, lambda i: i > 99).count() == 0


def test_top_k_repeated_ids_and_empty_vectors(spark, monkeypatch):
    """Rows that repeat a vec_id are queries and candidates of their own; empty vectors score 0."""
    from precis.llm import norm_topk
    from precis.llm.oracle import OP9
    import duckdb
    monkeypatch.setattr(norm_topk, "BUCKET", 10)
    monkeypatch.setattr(norm_topk, "CHUNK", 2)
    rng = np.random.default_rng(3)
    rows = [(i % 45, (rng.normal(size=5) * (1 + i % 7)).tolist()) for i in range(120)]
    rows += [(20, []), (20, rows[20][1]), (7, []), (0, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in norm_topk.top_k(df, lambda i: i % 20 == 0).collect())
    assert got == brute_top_k(rows, 20, 20)
    embeddings = df.toArrow()  # noqa: F841
    assert sorted(duckdb.sql(OP9).fetchall()) == got


# ------------------------------------------------------------------ pages
def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    from precis.llm.page_diff import shared
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = (rng.integers(0, 5, size=rng.integers(0, 30)).tolist() for _ in range(2))
        for cells in (10 ** 9, 20):
            at = shared(a, b, cells)
            rest = iter(b)
            assert len(at) == lcs_length(a, b) and at == sorted(set(at)) and all(a[i] in rest for i in at)


def test_article_text_of_the_table(spark):
    import html
    from precis.llm.page_diff import extract
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [html.unescape(re.sub(r"</?b>", "", p)).split() for p in re.split(r"</?(?:p|h1|br)>", article)]
        assert got[r.page_id] == " ".join(" ".join(p) for p in parts if p)


def page(*lines):
    return "<html><head><title>t</title></head><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def test_differencing_without_marked_article(spark):
    from precis.llm.page_diff import extract
    rows = [(1, "http://a.org/x/1", page("Home", "About", "first text", "more", "Imprint")),
            (2, "http://A.org/x/2", page("Home", "About", "second &amp; other", "Imprint")),
            (3, "http://b.org/x/1", page("Home", "alone on its host")),
            (4, "http://a.org/x/1", page("Home", "About", "first text", "more", "Imprint")),
            (5, None, page("no url")), (6, "http://c.org/", None), (7, "http://c.org/1", "")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "second & other" and got[4] == "first text more" and got[3] == "Home alone on its host"
    assert got[5] == "no url" and got[6] == got[7] == ""


def test_markup_is_left_out():
    from precis.llm.page_diff import ARTICLE, HEADING, blocks
    html = ("<body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><!-- <p>no</p> --><main><h1>Title</h1>"
            "<p>One <b>bo</b>ld&nbsp;&lt;x&gt;\n text<br>next<script>var a = '</p>';</script><p>Two<div class='share-bar'>Share</div>"
            "<div id=comments><p>Nice!</p></div><form><p>Mail</p></form><aside>Side</aside><p class=\"ad\">Buy</p><p>Three</main>"
            "<div role='dialog'>Cookies</div><footer>Foot</footer>")
    assert [t for t, k in blocks(html) if k in (ARTICLE, HEADING)] == ["Title", "One bold <x> text", "next", "Two", "Three"]


def test_hot_host_over_many_chunks(spark, monkeypatch):
    """Chunks of ten pages give what one chunk gives."""
    from precis.llm import page_diff
    rows = [(i, f"http://{'hot' if i % 3 else i}.org/p/{i % 50:03}/{i}", page("Menu", f"text {i}", f"line {i % 7}", "Foot"))
            for i in range(400)]
    pages = spark.createDataFrame(rows + rows[:20], "page_id long, url string, html string")
    whole = Counter((r.page_id, r.text) for r in page_diff.extract(pages).collect())
    monkeypatch.setattr(page_diff, "PAGES_PER_CHUNK", 10)
    assert Counter((r.page_id, r.text) for r in page_diff.extract(pages).collect()) == whole
    assert page_diff.extract(pages.limit(0)).count() == 0


def test_url_rules(spark):
    from precis.llm.url_trees import judge
    urls = {"http://A.net/x": ("a.net", "/x", "net/", "block"), "https://m.example.net/en/1?q#f": ("m.example.net", "/en/1", "example.net/en/", "allow"),
            "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"), "http://x.org/fr/1": ("x.org", "/fr/1", "org/fr/", "allow"),
            "http://notexample.com/de/": ("notexample.com", "/de/", None, None), "http://a.net": ("a.net", "", None, None),
            "mailto:x": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None)}
    rows = [(i, u, 1) for i, u in enumerate([*urls] * 3)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = urls[rows[r.page_id][1]]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_url_trees_learn_held_out_labels(spark):
    """Trained on URLs that rules decide; URLs of the same kind but outside the sample get the same verdict."""
    from precis.llm import url_trees
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = (("net/", "block"), ("org/", "allow"))
    held = spark.createDataFrame([(10_000 + i, f"https://{h}.example.{'net' if i % 2 else 'org'}:1/en/{i}") for i, h in enumerate("abcdefgh" * 5)],
                                 "page_id long, url string")
    both = pages.select("page_id", "url").union(held)
    rows = {r.page_id: r for r in url_trees.judge(both, rules).collect()}
    assert len(rows) == both.count()
    for kind, verdict in ((1, "block"), (0, "allow")):                 # a port keeps the rules from deciding
        mine = [rows[10_000 + i] for i in range(40) if i % 2 == kind]
        assert all(r.rule is None for r in mine)
        assert sum(r.verdict == verdict for r in mine) >= 0.9 * len(mine)
    none = url_trees.judge(pages.limit(0))
    assert none.count() == 0 and none.columns == ["page_id", "host", "path", "rule", "verdict"]


def test_differencing_loses_no_main_text():
    """Names that only look like furniture, wrappers of the article, and headings that articles have in common."""
    from precis.llm import page_diff as P

    def text(page, *others):
        found, near = P.blocks(page), [P.blocks(o) for o in others]
        common = [set(P.shared([t for t, _ in found], [t for t, _ in n])) for n in near]
        both = common[0] & common[1] if len(near) == 2 else set()
        return P.main_text([t for t, _ in found], [k for _, k in found], common[0] if near else set(), both)

    article = "<article><h1>Title</h1><p>Some text.</p></article>"
    for wrapper in ('<body class="has-sidebar">%s</body>', '<body class="no-ads">%s</body>', '<body class="menu">%s</body>',
                    '<body><div class="page-menu-open">%s</div></body>', '<div id="sidebar-menu">%s</div>'):
        assert text(wrapper % article) == "Title Some text."
    for name in ("share-price", "side-note", "ad-hoc", "cookie-recipe", "search-results-summary"):
        assert text(f'<article><p class="{name}">Kept here.</p><p>More.</p></article>') == "Kept here. More."
    for name in ("ad", "ad-box", "site-footer", "left sidebar", "cookieBanner", "comments-list"):
        assert text(f'<article><p>One.</p><div class="{name}">Gone.</div><p>Two.</p></article>') == "One. Two."
    assert text('<article><p>One.</p></article><div class="related"><article><p>Teaser.</p></article></div>') == "One."
    headed = ["<article><h2>Release notes</h2><p>Body %d is here.</p><h2>Installation</h2><p>Python 3.13</p><p>More of %d.</p></article>" % (i, i)
              for i in range(3)]
    assert text(headed[0], headed[1]) == "Release notes Body 0 is here. Installation Python 3.13 More of 0."
    assert "Release notes Body 0 is here. Installation" in text(*headed)
    # a menu that the site hides in every article, found by both neighbours
    site = ["<article><p>Home | News | Contact</p><p>Own words of page %d, long enough to be an article of its own.</p><p>Quoted by all.</p></article>" % i
            for i in range(3)]
    assert text(*site) == "Own words of page 0, long enough to be an article of its own. Quoted by all."
