import random
import time

import pytest

from worktide.llm import extraction as x

LINKS = "".join(f'<li><a href="/{i}">Menu {i}</a></li>' for i in range(6))


def page(i: int, body: str, shell: str = "article") -> str:
    return (
        f'<!DOCTYPE html><html><head><title>T{i}</title><script>var t="</p>";</script></head><body>'
        f'<nav><ul>{LINKS}</ul></nav><div class="ad">Buy {i}</div><{shell}>{body}</{shell}>'
        f'<div class="sidebar">Side {i}</div><footer>&copy; me {i}</footer></body></html>'
    )


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    pages = pages.withColumn("text", x.F.lit("old")).withColumn("host", x.F.lit("old"))
    found = x.extract(pages)
    assert set(found.columns) == set(pages.columns)
    return {r.page_id: r.text for r in found.collect()}


def test_article(spark):
    bodies = [
        "<h1>Head &amp; line</h1><p><b>First  one.<br><p>Second\n two &lt;3</p>",
        '<p>Only <a href="x">a <i>link</i></a> here</p><div class="comments"><p>Nice!</p></div>',
        "<section><p>In</p> loose <ul><li>a<li>b</ul></section><form>Mail<input></form>",
        "cut off <p>text &am",
    ]
    rows = [(i, f"http://a.com/{i}", page(i, b)) for i, b in enumerate(bodies)]
    rows.append((9, "http://a.com/9", rows[0][2][: rows[0][2].index("</article>")]))
    got = texts(spark, [*rows, (20, "http://a.com/20", None), (21, None, ""), (22, None, "plain &eacute;")])
    assert got[0] == "Head & line\nFirst one.\nSecond two <3" == got[9]
    assert got[1] == "Only a link here"
    assert got[2] == "In\nloose\na\nb"
    assert got[3] == "cut off\ntext &am"
    assert got[20] == got[21] == ""
    assert got[22] == "plain é"


def test_root_is_inferred_without_article_element(spark):
    rng = random.Random(1)
    rows = [
        (i, "http://b.com/", page(i, "<div class='notice'>Cookies!</div>" + "".join(
            f"<p>{' '.join(str(rng.random()) for _ in range(30))}</p>" for _ in range(1 + i % 4)
        ), "div"))
        for i in range(8)
    ]
    got = texts(spark, rows)
    assert all(len(got[i].split("\n")) == 1 + i % 4 and "Cookies" not in got[i] for i in range(8))


def test_wrapper_has_optional_and_repeated_groups():
    one = x.page_wrapper(x.tree("<ul><li>a</li><li>b</li></ul><p>x</p>"))
    two = x.page_wrapper(x.tree("<ul><li>c</li></ul><h2>t</h2><p>y</p>"))
    assert x.expression(x.merged(one, two)) == "<#page><ul><li>#text</>+</><h2>'...'</>?<p>#text</></>"
    pairs = x.page_wrapper(x.tree("<h2>a</h2><p>b</p>" * 3))
    assert x.expression(pairs).startswith("<#page>(<h2>") and x.expression(pairs).endswith(")+</>")


@pytest.mark.parametrize("parts", [2, 3])
def test_folding_in_any_grouping_gives_the_same_decision(parts):
    pages = [page(i, "<p>a b c</p>" * (1 + i % 3) + "<h2>t</h2>" * (i % 2)) for i in range(12)]
    whole = None
    for p in pages:
        own = x.page_wrapper(x.tree(p))
        whole = own if whole is None else x.merged(whole, own)
    some = []
    for k in range(parts):
        part = None
        for p in pages[k::parts]:
            own = x.page_wrapper(x.tree(p))
            part = own if part is None else x.merged(part, own)
        some.append(part)
    other = some[0]
    for part in some[1:]:
        other = x.merged(other, part)
    assert x.decide(whole, 12) == x.decide(other, 12)


def test_wrapper_stays_bounded():
    rng = random.Random(2)
    whole = None
    for _ in range(60):
        body = "".join(f"<{t}>x</{t}>" for t in rng.choices(["p", "h2", "h3", "ul", "pre", "table"], k=60))
        own = x.page_wrapper(x.tree(body))
        whole = own if whole is None else x.merged(whole, own)
    assert len(whole[3]) <= x.LEVEL


def test_each_template_of_a_host_has_its_root(spark):
    def body(i, n=4):
        return "".join(f"<p>word{i}x{k} of page {i} and part {k} of it</p>" for k in range(n))

    shells = ["<article>{}</article>", "<main>{}</main>", "<div class='post'>{}</div>", "<section>{}</section>"]
    rows, want = [], {}
    for i in range(60):
        shell = shells[0 if i % 10 < 7 else i % 10 - 6]
        # One host with four templates, one with two div templates, and pages without host.
        for k, (host, own) in enumerate([
            ("http://m.com/", shell), ("http://d.com/", "<div class='{}'>{{}}</div>".format("ab"[i % 5 == 0])), (None, shell),
        ]):
            key = 100 * k + i
            url = host and f"{host}{i}"
            rows.append((key, url, f"<html><body><h4>Site</h4>{own.format(body(key))}</body></html>"))
            want[key] = [f"word{key}x{p} of page {key} and part {p} of it" for p in range(4)]
    got = texts(spark, rows)
    assert {k: v.split("\n") for k, v in got.items()} == want


@pytest.mark.parametrize("n", [5, 400])
def test_names_of_their_own_at_any_number_of_pages(spark, n):
    rows, want = [], {}
    for i in range(n):
        slug = "".join(chr(97 + int(c)) for c in str(7919 * i + 100003))
        body = f"<h1>t{slug}</h1><p>text of {slug}</p><p>and its end {slug * 3}</p>"
        menu = "".join(f"<li><a href='/{k}'>Menu {k}</a></li>" for k in range(6))
        for k, shell in enumerate(["article", "div"]):
            rows.append((
                1000 * k + i, f"http://{shell}.com/{i}",
                f"<body class='{slug}'><ul>{menu}</ul><{shell} id='x-{slug}'>{body}</{shell}>"
                "<section><h6>All rights kept</h6></section></body>",
            ))
            want[1000 * k + i] = f"t{slug}\ntext of {slug}\nand its end {slug * 3}"
    assert texts(spark, rows) == want


def test_levels_by_tag_stay_so_in_any_grouping():
    pages = [x.page_wrapper(x.tree(f"<div class='{chr(97 + i % 26) * (1 + i // 26)}'><b class=ad>x</b><p>t{i}</p></div>"))
             for i in range(300)]

    def folded(some):
        whole = some[0]
        for own in some[1:]:
            whole = x.merged(whole, own)
        return whole

    one = folded(pages)
    assert [p[0] for p in one[3]] == [x.BY_TAG] and [p[0] for p in one[3][0][3]] == ["div"]
    assert x.decide(one, 300) == x.decide(x.merged(folded(pages[:110]), folded(pages[110:])), 300)
    assert x.decide(one, 300) == x.decide(x.merged(folded(pages[:20]), folded(pages[20:])), 300)


def test_names_do_not_empty_a_page(spark):
    body = "".join(f"<p>Paragraph {k} of the text that matters</p>" for k in range(4))
    shells = [
        "<body class='has-sidebar'><div>{}</div>", "<body><div id='main' class='with-sidebar'>{}</div>",
        "<body><article class='post comment-open'>{}</article>", "<body class='login'><main class='widget'>{}</main>",
        "<body><form action='x'><article>{}</article></form>", "<body><form action='x'><div>{}</div></form>",
        "<body><div class='widget'>{}</div>", "<body><div class='no-share'>{}</div>",
    ]
    left_out = "<div class='sidebar'>Side</div><div id='cookie-notice'>Cookies</div><form>Mail <input></form>"
    rows = [(i, f"http://s{i}.com/", f"<html>{x.format(body)}{left_out}</body></html>") for i, x in enumerate(shells)]
    # The same shells on one host.
    rows += [(100 + i, "http://all.com/", html) for i, _, html in rows]
    want = "\n".join(f"Paragraph {k} of the text that matters" for k in range(4))
    assert texts(spark, rows) == {i: want for i, _, _ in rows}


def test_copies_of_a_page_are_no_template(spark):
    body = "<h1>Head</h1><p>The one paragraph of it</p><p>{}</p>"
    rows = [(i, "http://one.com/", f"<body><div>{body.format('end')}</div></body>") for i in range(5)]
    rows += [(10 + i, "http://two.com/", f"<body><div>{body.format('end' * (1 + i % 2))}</div></body>") for i in range(6)]
    # From three different pages on, the heading is the template's.
    rows += [(20 + i, "http://three.com/", f"<body><h4>Site</h4><div><p>{'end' * (3 + i)}</p></div></body>") for i in range(3)]
    got = texts(spark, rows)
    for i, _, _ in rows[:11]:
        end = "end" if i < 10 else "end" * (1 + i % 2)
        assert got[i] == f"Head\nThe one paragraph of it\n{end}"
    assert [got[20 + i] for i in range(3)] == ["end" * (3 + i) for i in range(3)]


@pytest.mark.parametrize("shell", ["article", "main"])
def test_linked_groups_of_an_article_stay(spark, shell):
    references = "".join(f"<li><a href='{k}'>Reference {k}</a></li>" for k in range(5))
    body = f"<h2><a href='#a'>One</a></h2><p>Text</p><h2><a href='#b'>Two</a></h2><p>More</p><ol>{references}</ol>"
    rows = [(i, "http://r.com/", page(i, body, shell)) for i in range(4)]
    want = "\n".join(["One", "Text", "Two", "More", *(f"Reference {k}" for k in range(5))])
    # A page of nothing else has its list.
    rows.append((9, "http://r.com/9", page(9, f"<ol>{references}</ol>", shell)))
    assert texts(spark, rows) == {i: want for i in range(4)} | {9: want[want.index("Reference"):]}


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50000 + "end", "<a " * 300000, '<a ">" x ' * 100000, "<x-y>" * 50000 + "end", "<p id='" * 100000,
     "<li><div>" + "<x>" * 30000 + "<li>a</li>" * 30000],
    ids=["nested", "unclosed tags", "quotes", "unknown tags", "unclosed quotes", "items"],
)
def test_hard_pages_take_linear_time(page):
    own = x.page_wrapper(x.tree(page))
    both = x.merged(own, x.page_wrapper(x.tree(page)))
    assert x.written(x.read(x.written(both))) == x.written(both)
    start = time.monotonic()
    assert x.main_text(page, x.decide(both, 2)).strip()
    assert time.monotonic() - start < 30


def test_deep_page_beside_others(spark, tmp_path):
    deep = "<html><body>" + "<div>" * 3000 + "<p>inmost</p>"
    rows = [(1, "http://a.com/1", deep), (2, "http://a.com/2", "<body><article><p>one</p></article></body>"), (3, None, deep)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in x.extract(pages).collect()} == {1: "inmost", 2: "one", 3: "inmost"}


@pytest.mark.parametrize("name", ["post-comments", "social-share-box", "comment-list", "left_sidebar", "user-comments-wrapper"])
def test_side_parts_under_longer_names(name):
    page = f"<article><p>text</p><div class='{name}'><p>side</p></div><p class='no-comments'>more</p></article>"
    assert x.main_text(page, x.decide(x.page_wrapper(x.tree(page)), 1)) == "text\nmore"


def test_element_without_end_is_text():
    assert x.main_text("<p>a <b and c", x.decide(x.page_wrapper(x.tree("")), 1)) == "a <b and c"
    assert x.main_text("<p title='a > b'>c</p>", x.decide(x.page_wrapper(x.tree("")), 1)) == "c"
