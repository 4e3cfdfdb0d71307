import itertools
import math
import random

import pytest

from ledgerlens.llm import html_extraction as h
from ledgerlens.llm.html_pages import labelled_pages

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model():
    return h.fit()


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{body}</body></html>"


ARTICLE = "<article><h1>A title</h1><p>First words of the story &amp; more.</p><p>Second part.</p></article>"
TEXT = "A title First words of the story & more. Second part."


@pytest.mark.parametrize("around", [
    "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>{}",
    "<header><h1>The Site</h1><a href='/'>Home</a></header>{}<footer><p>&copy; 2024 The Site</p></footer>",
    "<div class='ad'>Buy this now.</div>{}<div class=\"advertisement\"><p>Buy that.</p></div>",
    "{}<aside><h3>Related</h3><ul><li><a href='/x'>Other story</a></li></ul></aside>",
    "<div class='cookie-notice'><p>We use cookies on this site.</p></div>{}",
    "{}<form action='/s'><label>Mail</label><input name=m><button>Send</button><p>No spam.</p></form>",
    "{}<section class='comments'><h3>Comments</h3><div class='comment'><p>I liked this story a lot, thank you.</p></div></section>",
    "<div id='sidebar'><p>About us and our team.</p></div>{}<script>var a = '</p><p>no';</script><noscript>no</noscript>",
    "<div class='page'><div class='menu'><a href='/1'>One</a> <a href='/2'>Two</a></div>{}</div>",
])
def test_only_the_article_is_kept(model, around):
    assert h.extract(page(around.format(ARTICLE)), model) == TEXT


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a b"), ("<p>a <b>b</b>c<br>d</p>", "a bc d"),
    ("<article><p>x &amp;amp; &#65;&#x42; &unknown; &lt;p&gt;</p></article>", "x &amp; AB &unknown; <p>"),
    ("<article><p>one\n\t two three</p>\n<p> four </p></article>", "one two three four"),
    ("<article><p><b>open<br><p>next</p></article>", "open next"), ("<article></div></p><p>stray</span></p>", "stray"),
    ("<article><table><tr><td>x<td>y</table></article>", "x y"), ("<article>1 < 2 and <p>b", "1 < 2 and b"),
    ("<article><p>a</p><!-- <p>hidden</p> --><p>b</p><!-- open", "a b"), ("<article><p title='a>b'>c</p></article>", "c"),
])
def test_markup(model, html, text):
    assert h.extract(html, model) == text


LONG = "The story goes on for a while with plain words that say what happened. " * 4


@pytest.mark.parametrize("part,text", [
    ("<p>The area is <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup></math> here.</p>", "The area is a=r2 here."),
    ("<p>See <math display='block'><semantics><mrow><mi>x</mi></mrow><annotation encoding='tex'>\\x</annotation></semantics></math> now.</p>", "See x now."),
    ("<p>A drawing <svg viewBox='0 0 1 1'><title>no</title><defs><text>no</text></defs><path d='M0'/><g><text>label</text></g></svg> stands here.</p>",
     "A drawing label stands here."),
    ("<ul><li><a href='/a'>First source of the story</a></li><li><a href='/b'>Second source of it</a></li></ul>",
     "First source of the story Second source of it"),
    ("<ol><li><a href='/a'>Annual report</a></li><li><a href='/b'>Press note</a></li></ol>", "Annual report Press note"),
])
def test_formulas_drawings_and_linked_lists_of_an_article_stay(model, part, text):
    body = f"<nav><a href='/'>Home</a></nav><div class='post'><h1>A title</h1><p>{LONG}</p>{part}<p>{LONG}</p></div><footer>Foot</footer>"
    assert h.extract(page(body), model) == f"A title {LONG.strip()} {text} {LONG.strip()}"


def brute_marginals(parents, own, pair):
    n, total, ones = len(parents), 0.0, [0.0] * len(parents)
    for states in itertools.product((0, 1), repeat=n):
        weight = math.exp(sum(own[k] * s for k, s in enumerate(states)) + sum(pair[states[parents[k]]][states[k]] for k in range(1, n)))
        total += weight
        for k, s in enumerate(states):
            ones[k] += s * weight
    return [x / total for x in ones]


@pytest.mark.parametrize("seed", range(6))
def test_sum_product_gives_exact_marginals(seed):
    r = random.Random(seed)
    n = r.randint(1, 10)
    parents = [-1] + [r.randrange(k) for k in range(1, n)]
    own = [r.uniform(-3, 3) for _ in range(n)]
    pair = [[r.uniform(-2, 2) for _ in range(2)] for _ in range(2)]
    assert h.marginals(parents, own, pair) == pytest.approx(brute_marginals(parents, own, pair))


def test_deep_pages_do_not_overflow(model):
    assert h.extract("<div>" * 20_000 + "<p>deep</p>", model) in ("deep", "")
    assert h.marginals([-1] + list(range(999)), [900.0] * 1000, [[5.0, -5.0], [-5.0, 5.0]])[-1] == pytest.approx(1)


def test_held_out_accuracy(model):
    right = total = 0
    for html in labelled_pages(200, seed=99):
        nodes = h.parse(html)
        own = [sum(model["weights"].get(f, 0.0) for f in found) for found in h.features(nodes)]
        for node, p in zip(nodes, h.marginals([n.parent for n in nodes], own, model["pair"])):
            if node.texts:
                total += 1
                right += (p > 0.5) == bool(node.label)
    assert right / total > 0.97


def test_rows(spark, model):
    rows = [(1, "u", page(ARTICLE)), (2, None, None), (None, "u", ""), (1, "u", page(ARTICLE)),
            (3, "u", page("<article>" + "<p>long text of words</p>" * 30_000 + "</article>"))]
    table = spark.createDataFrame(rows, PAGE)
    for name in ("text", "n_chars", "nodes"):
        table = table.withColumn(name, table.url)
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in h.main_text(table, model).collect()), key=str)
    whole = " ".join(["long text of words"] * 30_000)
    assert got == sorted([(1, "u", TEXT, len(TEXT)), (2, None, "", 0), (None, "u", "", 0), (1, "u", TEXT, len(TEXT)), (3, "u", whole, len(whole))], key=str)
    assert h.main_text(spark.createDataFrame([], PAGE), model).collect() == []
