import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimsieve.llm import html


def body(page):
    """The text of a page whose host has no templates."""
    blocks = html.parse(page).blocks
    for place in (1, 2):
        if any(b[place] for b in blocks):
            blocks = [b for b in blocks if b[place]]
            break
    return " ".join(b[0] for b in blocks)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("<p>one<p>two<b>bold</b>er", "one twobolder"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a b c d"),
        ("<table><tr><td>a<td>b<tr><th>c</table>", "a b c"),
        ("a&amp;b &lt;c&gt; &nbsp; &#233;&#x4e2d; &copy &bogus; &am", "a&b <c> é中 © &bogus; &am"),
        ("<nav>menu</nav><article><h1>T</h1><p>x<br>y</p><div class=ad>buy</div></article><footer>f</footer>", "T x y"),
        ("<main><p>x</p><aside>y</aside></main><div>z</div>", "x"),
        ("<header>h</header><article><header><h1>T</h1></header>x</article>", "T x"),
        ("<article>a<section id='comments'><article>c</article></section></article>", "a"),
        ("<article>a<div class='cookie-notice'>b</div><form>c</form><p class='Sidebar'>d</p><div hidden>e</div></article>", "a d"),
        ("<article>a<h2 id='search'>b</h2><h2 id='binary-search'>c</h2><h3 id='sharing'>d</h3><p id='navigation'>e</p></article>", "a b c d e"),
        ("<article><section id='login'>a</section><section id='related-work'>b</section><div class='image-related'>c</div></article>", "a b c"),
        ("<main><ul class='menu'><li>soup<li>cake</ul><p>so <math><mi>x</mi></math></p><div id='header-files'>h</div></main>", "soup cake so x h"),
        ("<article><div class='adventure headers-up'>kept</div></article>", "kept"),
        ("<article>a<script>var t='</p><b>';</script><style>p{}</style><!-- <p>c</p> -->b", "a b"),
        ("<article>a <span class='ad'>kept</span> b", "a kept b"),
        ("<ARTICLE><P TITLE='a>b'>x</P></ARTICLE>", "x"),
        ("<article><p>x</p></div></p>y</article>", "x y"),
        ("<article><p>cut off <b", "cut off"),
        ("<article><p>cut off</p><!-- open", "cut off"),
        ("a < b and c<3 <3", "a < b and c<3 <3"),
        ("<title>t</title><body>x", "x"),
        ("<article><textarea>a</textarea><select><option>b</select>c<noscript>d</noscript>", "c"),
        ("<article>" + "<div>" * 3000 + "deep", "deep"),
    ],
)
def test_parsing(page, text):
    assert body(page) == text


PAGES = "page_id long, url string, html string, text string, __n string"


def extract(spark, workspace, pages, **how):
    rows = spark.createDataFrame([(*p, "t", "n") for p in pages], PAGES).repartition(3)
    out = html.main_text(rows, workspace, **how)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    return out


def site(host, n, menu="<div><ul><li>Home<li>News</ul></div>", begin=0):
    return [(begin + k, f"https://www.{host}/p{k}", f"{menu}<div><p>story {k} of {host}</p><p>and more of it here</p></div><div>written by us</div>") for k in range(n)]


def test_templates_go_where_markup_says_nothing(spark, workspace):
    pages = site("a.example", 20) + site("b.example", 3, begin=100)
    found = {r["page_id"]: r["text"] for r in extract(spark, workspace, pages).collect()}
    assert found[4] == "story 4 of a.example and more of it here"
    assert found[101] == "Home News story 1 of b.example and more of it here written by us"


def plain_templates(pages, min_pages):
    """By host, the subtrees on enough different pages, by counting them one by one."""
    seen = {}
    for _, url, page in pages:
        parsed = html.parse(page)
        seen.setdefault(url.split("/")[2].removeprefix("www."), {}).setdefault(tuple(b[0] for b in parsed.blocks), {t for t, _, _ in parsed.trees})
    return {host: {t for t, n in Counter(t for trees in some.values() for t in trees).items() if n >= min_pages} for host, some in seen.items()}


def plain_text(page, templates):
    parsed = html.parse(page)
    sizes = [len(b[0]) for b in parsed.blocks]
    gone = {k for t, a, b in parsed.trees if t in templates and 2 * sum(sizes[a:b]) <= sum(sizes) for k in range(a, b)}
    left = [b for k, b in enumerate(parsed.blocks) if k not in gone]
    for place in (1, 2):
        if any(b[place] for b in left):
            left = [b for b in left if b[place]]
            break
    return " ".join(b[0] for b in left)


def test_templates_against_counting_one_by_one(spark, workspace):
    rng = random.Random(4)
    bits = [f"<div class=c{k}><p>part {k}</p><ul><li>x{k}</ul></div>" for k in range(40)]
    pages = []
    for k in range(240):
        inner = "".join(rng.choices(bits, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 6)))
        own = f"<div>own words of page {k} {'and more ' * rng.randint(0, 4)}</div>"
        wrap = rng.choice(["{}", "<article>{}</article>", "<main>{}</main>", "<section><div>{}</div></section>"])
        pages.append((k, f"http://h{k % 3}.example/{k}", rng.choice(bits) + wrap.format(inner + own) + bits[0]))
    pages += [(1000 + k, url, page) for k, url, page in pages[:30]]
    templates = plain_templates(pages, 8)
    found = {r["page_id"]: r["text"] for r in extract(spark, workspace, pages).collect()}
    assert found == {k: plain_text(page, templates[url.split("/")[2]]) for k, url, page in pages}
    without = {r["page_id"]: r["text"] for r in extract(spark, workspace, pages, min_pages=10**9).collect()}
    assert sum(found[k] != without[k] for k in found) > 200  # the templates decide


def test_a_menu_of_a_small_part_of_a_large_host_goes(spark, workspace):
    pages = site("a.example", 12) + site("a.example", 300, menu="", begin=100)
    found = {r["page_id"]: r["text"] for r in extract(spark, workspace, pages).collect()}
    assert found[4] == "story 4 of a.example and more of it here"


def test_deep_pages_take_memory_in_proportion():
    page = html.parse("".join(f"<div>w{k} " for k in range(20_000)))
    assert len(page.blocks) == 20_000 and len(page.trees) == 20_000 and page.trees[-1][1:] == (0, 20_000)


def test_templates_are_of_one_host_and_of_many_pages(spark, workspace):
    pages = [(k, f"http://h{k}.example/", "<div>same words</div><div><p>own words of page number %d</p></div>" % k) for k in range(30)]
    assert all("same words" in r["text"] for r in extract(spark, workspace, pages).collect())
    copies = [(k, f"http://one.example/{k}", "<div>same words</div><div><p>the same page again</p></div>") for k in range(30)]
    assert {r["text"] for r in extract(spark, workspace, copies).collect()} == {"same words the same page again"}


def test_most_of_a_page_is_no_template(spark, workspace):
    long = "<div>" + "a long story that many pages carry " * 5 + "</div>"
    pages = [(k, f"http://one.example/{k}", f"{long}<p>page {k}</p>") for k in range(30)]
    assert all("long story" in r["text"] for r in extract(spark, workspace, pages).collect())


def test_cases(spark, workspace):
    pages = [(1, None, None), (2, "", ""), (None, None, "<p>x</p>"), (3, "no host", "<p>é</p>"), (3, "no host", "<p>é</p>"), (4, "http://u@H.example:80/x", "y" * 200_000)]
    found = Counter((r["page_id"], r["url"], r["text"][:5], r["n_chars"]) for r in extract(spark, workspace, pages).collect())
    assert found == Counter({(1, None, "", 0): 1, (2, "", "", 0): 1, (None, None, "x", 1): 1, (3, "no host", "é", 1): 2, (4, "http://u@H.example:80/x", "yyyyy", 200_000): 1})
    assert extract(spark, workspace, []).count() == 0


def test_host(spark):
    urls = [None, "http://www.A.example/x", "https://u:p@b.example:8080?x", "//c", "ftp://d.example#f"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(html.host(F.col("u"))).collect()] == ["", "a.example", "b.example", "", "d.example"]


LONG = "a story of many words " * 5


@pytest.mark.parametrize(
    "page, text",
    [
        ("<div class='layout no-sidebar'><article>x</article></div>", "x"),
        ("<div class='has-sidebar'><div class='with-comments'><p>x</p></div><p>y</div>", "x y"),
        ("<div class='search-results'><article>x</article></div><div id=comments>c</div>", "x"),
        ("<div class='sidebar-left'><main>x</main></div>" + LONG, "x"),
        ("<article><header class='entry-header'><h1>Title</h1></header>x</article>", "Title x"),
        (f"<div class=widget><p>{LONG}</p></div><div class=sidebar>s</div>", LONG.strip()),
        ("<article>x</article><div id=comments><article>c</article><article>d</article></div>", "x"),
        ("<div class=sidebar><article>t</article></div><div class='search-page'><article>the longer one</article></div>", "the longer one"),
        ("<div class=widget><div class=search><article>x</article></div></div><p>other words that stand outside", "x"),
        ("<article>a b c<div class='post__ad'>d</div><div class='social_links'>e</div></article>", "a b c"),
    ],
)
def test_wrappers_named_by_what_they_hold_stay(page, text):
    assert body(page) == text


def test_a_page_with_a_named_block_behind_the_first_does_not_end_the_job(spark, workspace):
    page = "<p>one</p><div><p>two</p></div><div class='sidebar'>x</div><div><p>three</p></div>"
    assert {type(n) for tree in html.parse(page).trees for n in tree} == {int}
    pages = spark.createDataFrame([(1, "http://a.b/c", page)], "page_id long, url string, html string")
    assert html.main_text(pages, workspace).head()["text"] == "one two three"


@pytest.mark.parametrize("digits, text", [("9" * 5000, "\ufffd"), ("0" * 5000 + "65", "A"), ("1114112", "\ufffd"), ("11141110", "\ufffd"), ("00", "\ufffd"), ("x" + "f" * 5000, "\ufffd")])
def test_references_of_many_digits(digits, text):
    assert body(f"<p title='&#{digits};'>a&#{digits};b") == f"a{text}b"
