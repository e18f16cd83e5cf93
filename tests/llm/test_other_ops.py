"""URL rules, embeddings and web pages."""

import numpy as np
import pytest

from blockloom.llm import embeddings, html, urls
from blockloom.llm.components import components


def fits(rule, host, path):
    return (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    own = [r for r in rules if fits(r, host, path)]
    best = max(own, key=lambda r: (len(r.host + r.path), len(r.host), r.verdict == "block"), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else "allow"


def test_url_rules_against_each_rule(spark):
    rng = np.random.default_rng(1)
    hosts = ["org", "a.org", "b.a.org", "xa.org", "com", "c.com", "ORG", "", "..", "a.org."]
    paths = ["", "/", "/es/", "/en/1", "/en/12/x", "?q=/", "#/es/", "/es/x?y", "/ä"]
    made = [urls.Rule(h, p, v) for h in ("org", "a.org", "b.a.org", "com") for p in ("", "/", "/en/1", "/e", "/es/") for v in (("allow", "block")[int(rng.integers(2))],)]
    made += [urls.Rule("com", "/", "block"), urls.Rule("com", "/", "allow")]
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(900, None), (901, ""), (902, "no scheme"), (903, "x://a.org/es/://b"), (None, "http://a.org/"), *[(904, "http://hot.a.org/es/1")] * 300]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    got = urls.judge(pages, made).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *map(str, brute(u, made))) for i, u in rows)
    assert sorted(tuple(map(str, (r.page_id, r.host, r.path, r.rule, r.verdict))) for r in got) == want
    assert urls.judge(pages.limit(0)).collect() == []


def links_of(rows, least):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in ok}
    for a, (i, x) in enumerate(ok):
        for j, y in ok[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].add(j)
                links[j].add(i)
    return links


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    for i in range(60):
        rows.append((200 + i, (np.array(rows[i % 20][1]) * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.15).tolist()))
    rows += [(300 + i, rows[3][1]) for i in range(40)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [None] * 8), (404, [float("inf"), *[1.0] * 7]), (405, [1.0, 2.0]), (406, [2.0, 4.0]), (407, []), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as home", "2 as copies")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = links_of(rows, 0.9)
    got = {r.vec_id: r for r in embeddings.near_duplicates(frame, block=32).collect()}
    assert len(got) == len(rows)
    found, real = sum(r.n_links for r in got.values()), sum(map(len, want.values()))
    assert real * 0.97 <= found <= real
    for i, r in got.items():
        assert r.n_links <= len(want.get(i, ()))
        assert r.kept == (i is not None and r.component_id == i)
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []


def test_recall_of_planted_pairs_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.95 in 64 dimensions among unrelated vectors: the hardest that still link."""
    rng = np.random.default_rng(8)
    x = embeddings.unit_rows(rng.normal(size=(3000, 64)).tolist())
    other = rng.normal(size=(400, 64))
    other -= (other * x[:400]).sum(1, keepdims=True) * x[:400]
    other /= np.sqrt((other * other).sum(1, keepdims=True))
    c = rng.uniform(0.901, 0.95, (400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, c * x[:400] + np.sqrt(1 - c * c) * other]))]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.selectExpr("sum(n_links)").collect()[0][0] >= 0.9 * 800


def test_kmeans_centres_are_unit_vectors():
    x = embeddings.unit_rows(np.random.default_rng(1).normal(size=(200, 6)).tolist())
    c = embeddings.spherical_kmeans(x, 9)
    assert c.shape == (9, 6) and np.allclose((c * c).sum(1), 1)


@pytest.mark.parametrize("pairs", [[], [(1, 2), (2, 3), (9, 8)], [(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 300)], [(4, 4)]])
def test_components(spark, pairs):
    parent = {x: x for p in pairs for x in p}
    for _ in parent:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in parent.items() if any(k in p and p[0] != p[1] for p in pairs)}


def test_chain_on_pages_that_it_has_not_seen():
    chain = html.fit(html.labelled_pages(150))
    pages = html.labelled_pages(80, seed=77)
    right = sum(a == b for page, labels in pages for a, b in zip(chain.decode(page), labels))
    assert right >= 0.98 * sum(len(labels) for _, labels in pages)


def test_viterbi_is_the_best_of_all_labellings():
    from itertools import product

    chain = html.fit(html.labelled_pages(60))
    for page, _ in html.labelled_pages(30, seed=5):
        page = page[:8]
        e = [sum(chain.weights.get(f, 0.0) for f in own) for own in html.features(page)]

        def score(labels):
            s = sum(x for x, label in zip(e, labels) if label) + chain.first * labels[0] + chain.last * labels[-1]
            return s + sum(chain.moves[int(a), int(b)] for a, b in zip(labels, labels[1:]))

        assert np.isclose(score(chain.decode(page)), max(score(x) for x in product((False, True), repeat=len(page))))


PAGE = """<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav>
<article><h1>A &amp; B</h1><p>One  two<br>three.<p><b>Four &lt;five&gt;</b> six.<!-- no --><div class="ad">Buy it</div><p>Last &eacute;&#233;.</article>
<div id="comments"><p>I do not agree.</p></div><form><p>Your name</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    chain = html.fit(html.labelled_pages(200))
    assert html.main_text(PAGE, chain) == "A & B\nOne two three.\nFour <five> six.\nLast éé."
    assert html.main_text(None, chain) == html.main_text("", chain) == ""
    assert "cut" in html.main_text("<article><p>This is a text that is cut off am<b", chain).replace("cut off am", "cut")
    assert html.main_text("<article><p>a < b and c > d, as said.</p></article>", chain) == "a < b and c > d, as said."


def test_elements_that_are_not_raw_keep_the_page():
    chain = html.fit(html.labelled_pages(200))
    page = "<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><p>This is the first text of it.</p>{}<p>This is the second text of it.</p><p>And the last one.</p></article><footer>&copy; us</footer></body></html>"
    want = "This is the first text of it.\n{}This is the second text of it.\nAnd the last one."
    for odd in ("<svg class=icon />", "<svg/>", "<svg><path d='M0'/><style/><title/></svg>", "<math />", *[f"<{t} id=x>" for t in ("svg", "math", "select", "object", "video", "audio", "canvas", "datalist", "noscript", "template")]):
        assert html.main_text(page.format(odd), chain) == want.format(""), odd
        assert html.main_text(page.format(odd + "<p>A text between them is this.</p>" + odd), chain) == want.format("A text between them is this.\n"), odd
    for hidden in ("<svg><title>Icon</title></svg>", "<select><option>One</option></select>", "<video src=a>Your browser cannot play it.</video>", "<noscript>Turn it on.</noscript>"):
        assert html.main_text(page.format(hidden), chain) == want.format(""), hidden
    assert html.main_text(page.format("<p>Let <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> be so.</p>"), chain) == want.format("Let x<2 be so.\n")
    assert html.main_text(page.format("<object data=a><p>This stands for the object.</p></object>"), chain) == want.format("This stands for the object.\n")
    assert html.main_text(page.format("<xmp>if a < b &amp; <p> c then.</xmp>"), chain) == want.format("if a < b &amp; <p> c then.\n")


def test_pages_with_odd_columns(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", ""), (3, "w", "<p>" + "word " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "7 as n_chars")
    got = html.extract(pages, html.fit(html.labelled_pages(100))).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert html.extract(pages.limit(0), html.fit(html.labelled_pages(20))).collect() == []
