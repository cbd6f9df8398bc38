import html.parser
import math

import pytest

from quayside.llm import density
from quayside.llm.density import extract, extract_pages

ARTICLE = "<h1>A &amp; B</h1><p>First   paragraph, long enough to be a paragraph.<p>Second<br>one <b>bold</b>ly, <a href='x'>linked</a>.</p>"
TEXT = "A & B\n\nFirst paragraph, long enough to be a paragraph.\n\nSecond one boldly, linked."
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(20)) + "</ul>"
DENSE = "<p>" + "We value your privacy and this is long and dense text without a link. " * 8 + "</p>"


@pytest.mark.parametrize(
    "body",
    [
        f"<nav>{MENU}</nav><article>{ARTICLE}</article><footer>{DENSE}</footer>",
        f"<header>{DENSE}</header><main><article>{ARTICLE}</article><aside>{DENSE}</aside></main>",
        f"<div class='cookie-notice'>{DENSE}</div><div id=content>{ARTICLE}</div><div class=sidebar>{DENSE}</div>",
        f"<div class='wrap has-sidebar'><div id=content>{ARTICLE}</div></div><div id='comments'>{DENSE}{DENSE}</div>",
        f"<article>{ARTICLE}<section class='comments'>{DENSE}</section></article>",
        f"<form>{DENSE}<input value='>'></form><script>if (a < b) '</p>'</script><style>p {{}}</style><article>{ARTICLE}</article>",
        f"<div class='site-header'>{DENSE}</div><article><div class='article-header'><h1>A &amp; B</h1></div>{ARTICLE[ARTICLE.index('<p>') :]}<div class=ad>{DENSE}</div></article>",
        f"<div class=ad>{DENSE}</div><!-- <p>no</p> --><div><div>{ARTICLE}</div></div>{MENU}",
    ],
)
def test_article_alone(body):
    assert extract(f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>") == TEXT


@pytest.mark.parametrize(("source", "text"), [(None, ""), ("", ""), ("plain &eacute;", "plain é"), ("<nav>x</nav>", ""), ("<p>a<p>b", "a\n\nb"), ("<ArTicle><p>x</ARTICLE>", "x"), ("a < b <p title='", "a < b <p title='"), ("<article><p>unclosed", "unclosed")])
def test_odd_pages(source, text):
    assert extract(source) == text


def test_open_quotes_take_linear_time():
    assert "word" in extract("<article><p>word</p>" + "<a href=\"x>" * 20_000 + "</article>")


def test_very_long_page():
    assert extract("<article>" + "<p>word word</p>" * 50_000 + "</article>").count("word word") == 50_000


def test_rows(spark):
    rows = [(1, "u", "<article><p>é x</p></article>", "c"), (1, "u", "<article><p>é x</p></article>", "c"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract_pages(df).collect()), key=repr) == [(1, "u", "é x", 3), (1, "u", "é x", 3), (None, None, "", 0)]
    assert extract_pages(df.limit(0)).count() == 0


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<p title="a hidden gem">One gem.</p>', "One gem."),
        ("<p data-x='see class=ad here'>Two plain.</p>", "Two plain."),
        ('<p data-note="x hidden y">Three plain.</p>', "Three plain."),
        ('<section id="related-work"><p>Others did it before.</p></section>', "Others did it before."),
        ('<div class="share-price"><p>It fell to nine.</p></div>', "It fell to nine."),
        ('<div class="search-results"><p>We found it there.</p></div>', "We found it there."),
        ('<div class="noticePeriod"><p>Three months at least.</p></div>', "Three months at least."),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", "Let x=2 be."),
        ("<p>See <svg><text>a label</text></svg> there.</p>", "See a label there."),
        ("<object data='x'><p>Instead of it.</p></object>", "Instead of it."),
        ("<ol><li>Doe, J.: On the nature of some things, 2001. <a href='d'>doi</a></li></ol>", "Doe, J.: On the nature of some things, 2001. doi"),
        ("<ul><li><a href='d'>A whole reference of many words that happens to be a link, 2003</a></li></ul>", "A whole reference of many words that happens to be a link, 2003"),
    ],
)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div><div>{}</div></div>", "<main>{}</main>"])
def test_parts_that_stay(part, kept, around):
    assert extract(page(f"<nav>{MENU}</nav>" + around.format(ARTICLE + part) + f"<footer>{DENSE}</footer>")) == f"{TEXT}\n\n{kept}"


@pytest.mark.parametrize("name", ["ad", "site-footer", "CommentList", "cookie-notice", "left sidebar", "share-box", "reader_comments", "newsletter"])
@pytest.mark.parametrize("around", ["<article>{}</article>", "<div><div>{}</div></div>"])
def test_parts_that_go(name, around):
    assert extract(page(around.format(f"{ARTICLE}<div class='{name}'>{DENSE}</div>"))) == TEXT


def test_header_of_main_keeps_its_heading():
    assert extract(page(f"<header>{DENSE}</header><main><header><h1>A &amp; B</h1></header>{ARTICLE[ARTICLE.index('<p>') :]}</main>")) == TEXT


def test_references_beside_the_article():
    references = "<h2>References</h2><ol>" + "".join(f"<li>Doe, J. and Roe, R.: A long title of a paper on subject number {i}, journal of things, 200{i}. <a href='{i}'>doi</a></li>" for i in range(8)) + "</ol>"
    got = extract(page(f"<nav>{MENU}</nav><div id=c><div>{ARTICLE}</div><div>{references}</div></div><div class=side><a href=x>More</a></div>"))
    assert got.startswith(TEXT) and "subject number 7" in got and "More" not in got


def test_names_give_way_where_nothing_else_is():
    assert extract(page(f"<div class='widget'>{ARTICLE}</div>")) == TEXT


def test_a_thin_article_element_does_not_decide():
    thin = "<article>" + "".join(f"<div><span><a href='{i}'>Teaser {i}</a></span></div>" for i in range(30)) + "</article>"
    assert extract(page(f"{thin}<div><div>{ARTICLE}{DENSE}</div></div>")).startswith(TEXT)


class Plain(html.parser.HTMLParser):
    """Nodes of a well-formed page as [tag, children, own text]."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.root = ["#", [], []]
        self.stack = [self.root]
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, [], []]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2].append(" ".join(data.split()))


def plain_densities(source):
    """(tag, density, sum of the children's densities) of each node, by the formula."""
    root, out = Plain(source).root, []

    def count(node, linked):
        linked = linked or node[0] == "a"
        own = sum(map(len, node[2]))
        parts = [count(c, linked) for c in node[1]]
        return own + sum(p[0] for p in parts), len(parts) + sum(p[1] for p in parts), (own if linked else 0) + sum(p[2] for p in parts), sum((c[0] == "a") + p[3] for c, p in zip(node[1], parts))

    c_all, _, lc_all, _ = count(root, False)

    def formula(c, t, lc, lt):
        if not c:
            return 0
        t, lt = max(t, 1), max(lt, 1)
        log = math.log(c / max(lc, 1) * t / lt)
        base = math.log(c / max(c - lc, 1) * lc + lc_all / c_all * c + math.e)
        return c / t * max(log, 0) / max(math.log(base), 1)

    def visit(node, linked):
        linked = linked or node[0] == "a"
        at = len(out)
        out.append(None)
        own = sum(map(len, node[2]))
        sums = formula(own, 1, own if linked else 0, int(linked)) + sum(visit(c, linked) for c in node[1])
        # A node's numbers count what is inside a link above it as linked, too.
        c, t, lc, lt = count(node, linked)
        own_density = formula(c, t, lc, lt)
        out[at] = (node[0], own_density, sums)
        return own_density

    visit(root, False)
    return out


@pytest.mark.parametrize(
    "source",
    [
        "<div><p>one two three</p><p>four <b>five</b> six</p></div>",
        "<div><ul><li><a>x</a></li><li><a>yy <b>z</b></a></li></ul><div><p>some longer text with words</p>own text<p>and <a>link</a> more</p></div></div>",
        "<section>" + "<div><p>text &amp; text</p><a>link text that is long</a></div>" * 7 + "</section>",
    ],
)
def test_densities_by_the_formula(source):
    page = density._Page(source)
    m = density._Measured(page, True)
    got = [(page.tag[i], m.density[i], m.sums[i]) for i in range(len(page.tag))]
    want = plain_densities(source)
    assert [g[0] for g in got] == [w[0] for w in want]
    for k in (1, 2):
        assert [g[k] for g in got] == pytest.approx([w[k] for w in want])
