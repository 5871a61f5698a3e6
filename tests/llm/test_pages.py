"""HTML extraction on small pages."""

import math
import random

import pytest

from loglane.llm.html import extract, main_text

LONG = "This is a paragraph with enough words in it to count as the text of an article."
CASES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>a &lt;b&gt; &eacute;&#8364;&amp;amp;</p>", "a <b> é€&amp;"),
    (f"<body><nav><a href=x>Home</a><a href=y>More</a></nav><article><h1>Title</h1><p>{LONG}<br>x<p>{LONG} 2</article><footer>f {LONG}</footer>", f"Title\n\n{LONG} x\n\n{LONG} 2"),
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><script>var a='</p>';</script><div class='ad'>{LONG}</div><div><p>{LONG}</p><p>{LONG}!</p></div></body></html> ", f"{LONG}\n\n{LONG}!"),
    (f"<main><header><h1>In</h1></header><p>{LONG}</p><div id='comments'><p>{LONG}</p></div></main><header>Out</header>", f"In\n\n{LONG}"),
    (f"<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>{LONG}</article>", f"one\n\ntwo\n\na\n\nb\n\n{LONG}"),
    (f"<div><p>{LONG}<!-- <p>no</p> --><span hidden>no</span> <b>bold</b><i>it</i></p></div><aside>no</aside><form><p>no</p></form>", f"{LONG} boldit"),
    (f"<p>{LONG}</p><!-- never closed <p>x</p>", LONG),
    ("<a title='x>y'>z</a><", "z<"),
    ("<script>only</script>", ""),
]


@pytest.mark.parametrize("html, text", CASES)
def test_page(html, text):
    assert main_text(html) == text


def test_sections_without_article():
    page = f"<body><div id=page><div><h2>A</h2><p>{LONG}</p></div><div><h2>B</h2><p>{LONG}</p><p>{LONG}</p></div></div><div class=menu>{LONG}</div></body>"
    assert main_text(page) == f"A\n\n{LONG}\n\nB\n\n{LONG}\n\n{LONG}"


def test_sections_under_the_body():
    a, b = f"<p>{LONG}</p><p>{LONG} 2</p><p>{LONG} 3</p>", f"<p>SECOND {LONG}</p><p>{LONG} 4</p>"
    want = [LONG, f"{LONG} 2", f"{LONG} 3", f"SECOND {LONG}", f"{LONG} 4"]
    assert main_text(f"<body><div>{a}</div><div>{b}</div></body>") == "\n\n".join(want)
    links = "".join(f"<li><a href=x>link {i}</a>" for i in range(9))
    assert main_text(f"<body><div><ul>{links}</ul></div><div>{a}</div><div>{b}</div></body>") == "\n\n".join(want)


def test_formulas():
    math_ml = "<math><mi>x</mi><mo>+</mo><mi>y</mi><annotation encoding='t'>no</annotation></math>"
    assert main_text(f"<article><p>{LONG} {math_ml}</p></article>") == f"{LONG} x+y"


def grown(draw, depth):
    """A random tree: (tag, children), where a child is a tree or a text."""
    tag = draw.choice(["div", "div", "ul", "a", "span"]) if depth else draw.choice(["a", "span"])
    some = [grown(draw, depth - 1) if depth and draw.random() < 0.6 else "w" * draw.randint(1, 60) + " " for _ in range(draw.randint(1, 4))]
    return tag, some


def written(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(written, tree[1]))}</{tree[0]}>"


def by_hand(body):
    """The text by recursion over the tree, with every count taken anew for every node."""

    def texts(t, linked=False):
        if isinstance(t, str):
            return [(len(t.strip()), linked)]
        return [x for c in t[1] for x in texts(c, linked or t[0] == "a")]

    def nodes(t):
        return [] if isinstance(t, str) else [t, *[x for c in t[1] for x in nodes(c)]]

    def numbers(t, linked):
        size, links = sum(n for n, _ in texts(t)), sum(n for n, a in texts(t, linked) if a)
        return size, links, len(nodes(t)) - 1, sum(x[0] == "a" for x in nodes(t)[1:])

    size, links, _, _ = numbers(body, False)
    share = links / max(size, 1)

    def density(t, linked):
        c, lc, tags, lt = numbers(t, linked)
        ratio = max(c / max(lc, 1) * max(tags, 1) / max(lt, 1), 1.0)
        return 0.0 if not c or ratio <= 1 else c / max(tags, 1) * math.log(ratio) / math.log(c / max(c - lc, 1) * lc + share * c + math.e)

    found = []  # tree, density, sum of the children's densities, path

    def visit(t, linked, path):
        linked = linked or t[0] == "a"
        kids = [c for c in t[1] if not isinstance(c, str)]
        # From the last to the first, as sums of floats depend on the order.
        found.append((t, density(t, linked), sum(density(c, linked or c[0] == "a") for c in reversed(kids)), path))
        for c in kids:
            visit(c, linked, [*path, t])

    visit(body, False, [])
    of = {id(t): d for t, d, _, _ in found}
    best, _, most, path = max(found, key=lambda x: x[2])
    path = [*path, best] if most > 0 else [body]
    kept = {id(path[-1])}
    for t, _, _, above in found:
        if above and any(above[-1] is p for p in path) and not any(t is p for p in path):
            least = min(of[id(p)] for p in path)
            if max(of[id(x)] for x in nodes(t)) >= least > 0:
                kept.add(id(t))
    blocks = [""]

    def read(t, on):
        if isinstance(t, str):
            blocks[-1] += t if on else ""
            return
        block = t[0] in ("body", "div", "ul")
        blocks.extend([""] * block)
        for c in t[1]:
            read(c, on or id(t) in kept)
        blocks.extend([""] * block)

    read(body, False)
    return "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())


def test_densities_against_recursion():
    draw = random.Random(4)
    for _ in range(400):
        body = ("body", [grown(draw, 4) for _ in range(draw.randint(1, 4))])
        assert main_text(written(body)) == by_hand(body), written(body)


def test_deep_inline_elements():
    assert len(main_text("<b>" * 20_000 + "<div>x y</div>" * 20_000)) == 20_000 * 5 - 2


def test_long_and_broken():
    assert main_text("<p>" + "word " * 200_000) == " ".join(["word"] * 200_000)
    assert main_text("<div>" * 5000 + "x" + "</div>" * 3) == "x"
    assert main_text("<<<>>><p>ok</p") == "<<<>>>\n\nok"


def test_table(spark):
    rows = [(1, "u", None, "a"), (1, "u", "<p>x</p>", "b"), (None, None, "", "c"), (1, "u", "<p>x</p>", "b")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert sorted((r.row.text, r.text, r.n_chars) for r in got.collect()) == [("a", "", 0), ("b", "x", 1), ("b", "x", 1), ("c", "", 0)]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0
