"""HTML extraction against the same steps in memory, one host at a time, and against pages whose main text is known."""

import pytest

pytest.importorskip("folio.llm")

from folio.llm import html_extract as H
from folio.llm import store
from folio.llm.url_filter import host_of

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head><body><div id="cookie-notice">We use cookies</div>
<nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><header><h2>Site</h2></header><div class="sidebar">Side {n}</div><article><h1>Title {n}</h1><p><b>First &lt;para {n}<br>goes   on<p>Second&nbsp;para {n}</p>
<div class="ad">Buy</div><section class="comments"><p>Nice post</p></section></article><form><label>Mail</label><input></form><footer>&copy; x</footer></body></html>"""


def host_texts(pages):
    """Texts of all pages of one host, worked out in memory."""
    read = [H.parse(p or "") for p in pages]
    trees = [H.skeleton(t) for t, _, _ in read]
    wrapper, sums, seen = [], {}, {}
    for k, text in enumerate(sorted({H.to_text(t) for t in trees})):
        wrapper = H.from_text(text) if k == 0 else H.coarse(H.align(wrapper, H.from_text(text)))
    placed = [H.place(t, wrapper) for t in trees]
    alone = []
    for (_, texts, linked), tree, at in zip(read, trees, placed, strict=True):
        alone.append({k: (1, sum(len(texts[b]) for b in n[5]), sum(linked[b] for b in n[5]), False) for k, (n, _) in enumerate(H.walk(tree)) if n[5]})
        for k, (n, _) in enumerate(H.walk(tree)):
            if n[5]:
                pages_, chars, links = sums.get(at[k], (0, 0, 0))
                sums[at[k]] = (pages_ + 1, chars + alone[-1][k][1], links + alone[-1][k][2])
                seen.setdefault(at[k], set()).add("\n".join(texts[b] for b in sorted(n[5])))
    keep = set(H.main_nodes(wrapper, {k: (*v, len(seen[k]) == 1) for k, v in sums.items()}))
    out = []
    for (_, texts, _), tree, at, own in zip(read, trees, placed, alone, strict=True):
        slot = {b: k for k, (n, _) in enumerate(H.walk(tree)) for b in n[5]}
        got = [t for b, t in enumerate(texts) if at[slot[b]] in keep]
        out.append("\n\n".join(got or [t for b, t in enumerate(texts) if slot[b] in H.main_nodes(tree, own, alone=True)]))
    return out


def extract(spark, rows):
    return {r["page_id"]: r for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("few", [20_000, 0])
def test_equals_memory_on_all_pages(spark, data, monkeypatch, few):
    monkeypatch.setattr(store, "FEW", few)  # 0: joins by shuffle
    pages = spark.read.parquet(f"{data}/pages.parquet")
    want = {}
    for _, rows in pages.withColumn("host", host_of(pages["url"])).toPandas().groupby("host"):
        want.update(zip(rows["page_id"], host_texts(rows["html"].tolist()), strict=True))
    got = H.extract_pages(pages).collect()
    assert {r["page_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got) and any(want.values())


def test_main_text(spark):
    rows = [(i, f"http://a.com/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    rows += [(10, "http://b.com/", "<div class=page><div class=menu>Home</div><div class=text><p>Only text here, and quite a bit of it.</p><p>More.</p></div></div>"), (11, None, "plain &eacute; text"), (12, "http://c.com", None), (13, "http://c.com", ""), (14, "http://c.com", "<p>unclosed <b>bold")]
    made = spark.createDataFrame(rows + [rows[0]], "page_id long, url string, html string").selectExpr("*", "page_id AS id", "url AS host", "1 AS key", "2 AS slots")
    found = H.extract_pages(made).collect()
    got = {r["page_id"]: r for r in found}
    assert len(found) == len(rows) + 1
    for i in range(5):
        assert got[i]["text"] == f"Title {i}\n\nFirst <para {i} goes on\n\nSecond para {i}" and got[i]["n_chars"] == len(got[i]["text"])
    assert got[10]["text"] == "Only text here, and quite a bit of it.\n\nMore." and got[11]["text"] == "plain é text" and got[12]["text"] == got[13]["text"] == "" and got[14]["text"] == "unclosed bold"
    assert H.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_empty_no_page_and_repeats_stay(spark):
    article = "<article{c}><h1>Title {n}</h1><p>Body {n} of some length.</p><p>The same on all pages.</p></article>"
    around = '<div class="{c}"><nav><a href=x>Home</a></nav>{a}<aside>side</aside></div><footer>foot</footer>'
    plain = '<div><a href=1>Home</a> <a href=2>About us</a></div><div><h1>Title {n}</h1><p>Body {n} of some length.</p><p>The same on all pages.</p></div><div>Copyright of somebody</div>'
    talk = '<main><article><h1>Title {n}</h1><p>Body {n} of some length.</p><p>The same on all pages.</p></article><section class="comments"><article class="comment"><p>A long comment, the longest text by far of this page {n}.</p></article></section></main>'
    site = "<div id=content><h1>Title {n}</h1><div class=text><p>Body {n} of some length.</p><p>The same on all pages.</p></div></div><div class=related><a>Another page</a></div>"
    wraps = [around.replace("{c}", c).replace("{a}", article.replace("{c}", m)) for c, m in (("content-sidebar-wrap", ""), ("page has-sidebar", ""), ("x", ' class="post tag-social"'))]
    for n_pages in (1, 4):
        rows = [(100 * k + n, f"http://h{k}.org/{n}", p.replace("{n}", str(n))) for k, p in enumerate([*wraps, talk, site, *([plain] if n_pages > 1 else [])]) for n in range(n_pages)]
        for i, r in extract(spark, rows).items():
            assert r["text"] == f"Title {i % 100}\n\nBody {i % 100} of some length.\n\nThe same on all pages.", r["url"]
    mirrored = [(n, "http://m.org/", "<nav>n</nav><article><h1>One title</h1><p>One text on all mirrors.</p></article>") for n in range(5)]
    assert {r["text"] for r in extract(spark, mirrored).values()} == {"One title\n\nOne text on all mirrors."}
    bare = extract(spark, [(1, "http://e.org/1", "<nav>n</nav><div class='ad'>buy</div><article></article><footer>f</footer>"), (2, "http://e.org/2", "<div class='ad'>buy</div><article><p>words</p></article>")])
    assert bare[1]["text"] == "" and bare[2]["text"] == "words"


def test_hosts_of_many_skeletons_deep_and_long_pages(spark):
    """More skeletons than one merge takes, elements named after their page, thousands of nested or neighbouring elements."""
    rows = [(n, "http://hot.org/", f"<nav>menu {n}</nav><article id='my-post-number-{n}' class='post'>" + "".join(f"<{'h2' if n >> k & 1 else 'ul'}>t{n} part {k}</{'h2' if n >> k & 1 else 'ul'}><p>text {n} {k}</p>" for k in range(8)) + "</article>") for n in range(256)]
    got = extract(spark, [*rows, (900, "http://deep.org", "<div>" * 5000 + "deep" + "</div>" * 5000), (901, "http://wide.org", "<dl>" + "<dt>a<dd>b" * 20_000 + "</dl>"), (902, "http://long.org", "<p>" + "word " * 300_000)])
    assert all(got[n]["text"] == "\n\n".join(f"t{n} part {k}\n\ntext {n} {k}" for k in range(8)) for n in range(256))
    assert got[900]["text"] == "deep" and got[901]["text"].count("\n\n") == 39_999 and got[902]["n_chars"] == 5 * 300_000 - 1


def test_wrapper_is_union_free_and_matches_its_pages():
    pages = ["<article><h1>a</h1><p>b</p><p>c</p></article>", "<article><h1>a</h1><ul><li>x</li><li>y</li></ul><p>z</p></article>"]
    trees = [H.skeleton(H.parse(p)[0]) for p in pages]
    made = H.align(H.from_text(H.to_text(trees[0])), H.from_text(H.to_text(trees[1])))
    assert H.expression(made) == "<article><h1>#</>(<ul>(<li>#</>)+</>)?(<p>#</>)+</>"
    labels = [n[0] for n, _ in H.walk(made)]
    for tree in trees:
        assert [labels[k] for k in H.place(tree, made)] == [n[0] for n, _ in H.walk(tree)]
    nodes = [["div.a", False, False, True, [["p.x", False, False, True, [], []]], []] for _ in range(H.MOST_NODES)]
    for k, n in enumerate(nodes):
        n[0] = f"div.{'a' * (k % 97 + 1)}"
    assert [n[0] for n, _ in H.walk(H.coarse(nodes))] == ["div", "p"]


def test_raw_elements_end_where_they_end(spark):
    icon = '<div class="top"><svg class="i"/></div><article><h1>Title {n}</h1><p>Text {n} with <svg-icon name="x"></svg-icon> icons.</p><title-bar>bar {n}</title-bar><p>Last {n}.</p></article>'
    rows = [(k, f"http://icons.example/{k}", icon.replace("{n}", str(k))) for k in range(5)]
    open_ended = "<article><p>before</p>{}<p>after</p></article>"
    tags = ['<svg viewBox="0 0 1 1"><path d="M0"/>', "<math>", "<select><option>", "<object data=x>", "<select-box>", '<svg a="/>"><path/></svg>', "<!-->", "<!-- a > b -->", "<noscript>no</noscript>", "<template><p>no</p></template>"]
    rows += [(10 + k, f"http://h{k}.example/", open_ended.format(t)) for k, t in enumerate(tags)]
    rows += [(30, "http://s.example/", "<p>before</p><script>var a = '<p>';"), (31, "http://q.example/", "<article><p>before</p>" + "<select>" * 20_000 + "<p>after</p></article>")]
    got = extract(spark, rows)
    for k in range(5):
        assert got[k]["text"] == f"Title {k}\n\nText {k} with icons.\n\nbar {k}\n\nLast {k}."
    for k, t in enumerate(tags):
        assert got[10 + k]["text"] == "before\n\nafter", t
    assert got[30]["text"] == "before" and got[31]["text"] == "before\n\nafter"


def test_ambiguous_names_need_a_second_sign(spark):
    body = "<article><h1>Prices {n}</h1><p>The company of page {n} told its owners about the year.</p>{part}<p>Ending {n} of the report.</p></article>"
    kept = ['<p class="notice-period">The notice {n} ends in May.</p>', '<p class="share-price">It stood at {n}.</p>', '<div class="search-results-analysis"><p>Found {n} more.</p></div>']
    gone = ['<div class="share-box"><a href="/{n}">Send it on {n}</a></div>', '<div class="notice-box">All rights kept.</div>', '<div class="comments-list"><p>Reader {n} says so.</p></div>']
    rows = [(100 * k + n, f"http://p{k}.example/{n}", body.replace("{part}", part).replace("{n}", str(n))) for k, part in enumerate(kept + gone) for n in range(6)]
    got = extract(spark, rows)
    for k in range(6):
        for n in range(6):
            middle = [f"The notice {n} ends in May.", f"It stood at {n}.", f"Found {n} more."][k : k + 1]
            assert got[100 * k + n]["text"] == "\n\n".join([f"Prices {n}", f"The company of page {n} told its owners about the year.", *middle, f"Ending {n} of the report."])
