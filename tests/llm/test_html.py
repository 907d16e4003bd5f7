import html
import re

import pytest

from simquarry.llm.html_main import blocks, extract_main, main_text
from simquarry.llm.queries import op5_html_extraction

P = "The harbour was quiet that morning, and the boats lay still. Nobody had yet come down to the water."
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site-header"><h2>Site name here, welcome.</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/a">About</a></ul></nav>
<div class="cookie-notice">We use cookies. Accept, please, all of them.</div><aside class="sidebar"><p>Popular: one, two, three.</p></aside>
<main><article><header><h1>The&nbsp;harbour &amp; us</h1></header><p>%s</p><div class="ad">Buy now, cheap, today.</div><p>In<b>line</b> &lt;b&gt;
   spaced.<br>Next</p><ul><li>One</li><li>Two</li></ul><p><b>%s<br><p>Last.</p>
<form><label>Mail, please.</label><input></form><section id="comments"><p>First! Nice, really, very nice.</p></section></article></main>
<footer>&copy; All, rights.</footer></body></html>"""
WANT = f"The harbour & us {P} Inline <b> spaced. Next One Two {P} Last."


def test_article():
    assert main_text(PAGE % (P, P)) == WANT


def test_without_semantic_tags():
    body = "".join(f"<p>{P} Number {i}.</p>" for i in range(4))
    page = f"<body><div id=top><a href=/>Home</a> <a href=/x>News</a></div><div class=wrap><div class=post><h2>Title</h2>{body}<p>Short.</p></div><div class=related><a href=1>More, like this.</a></div></div><div id=footer>Copyright, us.</div></body>"
    assert main_text(page) == "Title " + " ".join(f"{P} Number {i}." for i in range(4)) + " Short."


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("<", "<"), ("plain text", "plain text"), ("<nav>Home</nav>", ""), ("<p>a &eacute; &#233; &#x41; &bogus;</p>", "a é é A &bogus;"), ("<script>x</script>", ""), ("<!-- x -->", ""), (f"<article><p>{P}</article><foo", P)])
def test_small_pages(page, text):
    assert main_text(page) == text


def test_paths():
    found = blocks("<div><p>one<p>two <i>in</i> line</p></div>")
    assert [(b.text, b.path) for b in found] == [("one", ("div", "p")), ("two in line", ("div", "p"))]


@pytest.mark.parametrize("body,text", [
    (f"<div id=content><h1>T</h1><div class=text><p>{P}</p><p>{P}</p></div></div>", f"T {P} {P}"),
    (f"<div><div class=a>{f'<p>{P}</p>' * 3}</div><div class=b><p>{P}</p></div></div>", " ".join([P] * 4)),
    (f"<div id=top><a href=/>Home</a></div><div><div>{f'<p>{P}</p>' * 9}</div><table><tr><td>1<td>2</table><ul><li>One</ul></div>", " ".join([P] * 9 + ["1 2 One"])),
    (f"<h1><a href=/t>T</a></h1><article><p>{P}</p></article>", f"T {P}"),
    (f"<div>Site line.</div><main><h2>T</h2><div>{f'<p>{P}</p>' * 2}</div></main>", f"T {P} {P}"),
])
def test_div_layouts(body, text):
    assert main_text(f"<body>{body}</body>") == text


@pytest.mark.parametrize("attrs", ["id=page class='has-sidebar'", "class='content no-sidebar'", "class='layout-sidebar-right'", "class='post comments-open'", "data-id=sidebar", "title='x class=ad y'", "aria-label='Search results and comments'", "class=sidebar"])
def test_wrapper_names(attrs):
    page = f"<body><div {attrs}><h1>T</h1><p>{P}</p><div class=sidebar-left><p>Ad, ad.</p></div><div><p>{P}</p></div></div><div class=site-footer><p>Us, here.</p></div></body>"
    assert main_text(page) == f"T {P} {P}"
    assert main_text(f"<body><div class=comments><article><p>{P}</p></article></div><div class=ad>No, no.</div></body>") == P


@pytest.mark.parametrize("name", ["legal", "notice", "search", "tags", "side", "share"])
def test_weak_names(name):
    page = f"<body><article><h1>T</h1><p>{P}</p><p class={name}>{P}</p><section class={name}><p>{P}</p><p>{P}</p></section><div class={name}><a href=1>A, b.</a></div><div class='{name} sidebar'>{P}</div></article></body>"
    assert main_text(page) == f"T {P} {P} {P} {P}"


@pytest.mark.parametrize("inner,text", [
    ("<svg class=icon/>", ""), ("<math/>", ""), ("<iframe src='a>b'/>", ""), ("<object data=x />", ""), ("<svg><title/><style/><path d=M1 /></svg>", ""),
    ("<iframe src=x>", ""), ("<template>", ""), ("<noscript>n</noscript><iframe>i</iframe><select><option>o</select>", ""),
    ("<math><mi>E</mi><mo>=</mo><mi>m</mi></math>", "E=m "), ("<object><p>In its place.</p></object>", "In its place. "), ("<svg><text>Axis</text></svg>", "Axis "),
])
def test_foreign_elements(inner, text):
    assert main_text(f"<article><p>{P}</p>{inner}<p>{P}</p></article>") == f"{P} {text}{P}"
    assert main_text(f"<article><p>{P}</p>{inner}<p>{P}</p><svg></svg></article>") == f"{P} {text}{P}"


def test_raw_text_reaches_the_end():
    assert main_text(f"<article><p>{P}</p><script>no</article>") == P


def test_table_is_the_article_element(spark, data):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in op5_html_extraction(spark, data).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        plain = html.unescape(re.sub(r"<[^>]*>", " ", inner))
        assert r.text == " ".join(plain.split()) and r.n_chars == len(r.text)


def test_columns_and_long_pages(spark):
    rows = [(1, "u", f"<article><p>{P * 5000}</p></article>", 3), (1, "u", None, 3)]
    out = extract_main(spark.createDataFrame(rows, "page_id long, url string, html string, TEXT int")).collect()
    assert {r["n_chars"] for r in out} == {len(P) * 5000, 0}
    assert extract_main(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("body,text", [("super<wbr>cali", "supercali"), ("foo<img src=x>bar", "foobar"), ("a<br>b", "a b"), ("a<hr/>b", "a b"), ("x<input>y", "xy"), ("<div class='legal-history'>Kept.</div>", "Kept."), ("<section class='search-algorithms'>Kept.</section>", "Kept."), ("<math><mi>x</mi></math>", "x"), ("<!-->a<!-- b --->c", "ac"), ('<a href="x>y</a> z', "y z")])
def test_inside_an_article(body, text):
    assert main_text(f"<article><p>{P}</p><div>{body}</div></article>") == f"{P} {text}"


@pytest.mark.parametrize("page", [
    "<a " * 300_000, "<" * 300_000, '<a href="' * 100_001 + ">", '<a "> ' * 100_001, "<div>" * 200_000 + "x", "<div>x" * 50_000, "<b>" * 100_000 + "<div>y" * 20_000, "</i>" * 200_000 + "z",
    "<div><i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "<li>" * 100_000, "<div class=ad>" * 100_000 + "t", "<iframe>" * 100_000, "<!--" * 100_000, "<![CDATA[" * 50_000, "<p a" + "a" * 300_000 + " b=1>x", "<p " + "a=' " * 100_001 + ">x", "&amp" * 100_000,
])
def test_malformed_and_deep_pages_take_linear_time(page):
    import time

    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 5


# ---------------------------------------------------------------- the method, plainly


def plain_blocks(tree, path=(), out=None, count=None):
    """(text, path, nodes, linked, marks) of a tree (tag, attributes, mark, children)."""
    out, count = [] if out is None else out, count or iter(range(1, 10**6))

    def walk(node, path, nodes, marks):
        tag, _, mark, children = node
        n = next(count)
        path, nodes, marks = (*path, tag), (*nodes, n), (*marks, (n, mark)) if mark else marks
        for child in children:
            if isinstance(child, str):
                out.append((child, path, nodes, 0, marks))
            elif child[0] == "a":
                out.append((child[3][0], path, nodes, len(child[3][0]), marks))
                next(count)
            else:
                walk(child, path, nodes, marks)

    walk(tree, (), (), ())
    return out


def plain_main(found):
    """The method by its definition, on tuples and sets."""
    from simquarry.llm import html_main as hm

    seen = [b for b in found if all(m != hm.BY_TAG for _, m in b[4])]
    articles, size = {}, {}
    for text, path, nodes, _, marks in seen:
        for n, t in zip(nodes, path, strict=True):
            size[n] = size.get(n, 0) + len(text)
            if t in ("article", "main"):
                articles[n] = t
    total = sum(len(b[0]) for b in seen)
    top = max(articles, key=lambda n: (articles[n] == "main", size[n], -n), default=-1)
    marked = {n for b in seen for n, _ in b[4]}
    around = {n: {a for b in seen if n in b[2] for a in b[2] if a in articles} for n in marked}
    exempt = {n for n in marked if n < top and top in around[n] or 2 * size[n] > total and len(around[n]) == len(articles)}
    content = [(*b[:4], tuple(m for m in b[4] if m[0] not in exempt)) for b in seen]
    content = [b for b in content if all(m == hm.WEAK for _, m in b[4])]
    if not content:
        return ""
    stat = {}
    for p in {b[1] for b in content}:
        own = [b for b in content if b[1] == p]
        n = len({b[2] for b in own})
        stat[p] = sum(len(b[0]) for b in own) / n, sum(len(re.findall(r"[.,;:!?…。，！？]", b[0])) for b in own) / n, n, sum(b[3] for b in own) / sum(len(b[0]) for b in own)
    score = {}
    for p, (length, punct, n, links) in stat.items():
        kin = [stat[q] for q in stat if q[:-1] == p[:-1]]
        fused = (0.5 * length + 0.5 * sum(k[0] for k in kin) / len(kin)) * (1 + 0.5 * punct + 0.5 * sum(k[1] for k in kin) / len(kin))
        score[p] = fused**0.5 * max(0.0, 1 - links) * n**0.5
    limit = hm.THRESHOLD * max(score.values())
    content = [b for b in content if not b[4] or score[b[1]] >= limit and 2 * b[3] < len(b[0])]
    if not content:
        return ""
    chosen = [b for b in content if score[b[1]] >= limit] or content
    firm = [b for b in content if 2 * b[3] < len(b[0]) or "h1" in b[1]] or content
    mains = set.intersection(*({n for n, t in zip(b[2], b[1], strict=True) if t == "main"} for b in chosen))
    firm = [b for b in firm if not mains or mains & set(b[2]) or "h1" in b[1]] or content
    shared = [x for x in zip(*(zip(b[2], b[1], strict=True) for b in firm), strict=False) if len(set(x)) == 1]
    nodes, path = [x[0][0] for x in shared], [x[0][1] for x in shared]
    for k, tag in enumerate(path):
        if tag in ("article", "main") and "article" not in path[k + 1 :]:
            nodes, path = nodes[: k + 1], path[: k + 1]
            break
    if path and path[-1] in ("p", "h1", "h2", "pre", "blockquote", "li", "td"):
        nodes = nodes[:-1]
    return " ".join(b[0] for b in content if not nodes or nodes[-1] in b[2])


def random_tree(rng, depth=0):
    from simquarry.llm import html_main as hm

    tag = "body" if not depth else rng.choice(["div", "div", "section", "article", "main", "nav", "aside", "ul", "table", "span"])
    tag = "div" if tag == "span" else tag
    name, mark = rng.choice([("", 0)] * 6 + [("class=sidebar", hm.STRONG), ("id=comments", hm.STRONG), ("class='x notice'", hm.WEAK), ("class=share", hm.WEAK)])
    if tag in ("nav", "aside"):
        mark = hm.BY_TAG
    elif tag in ("body", "main", "article"):
        mark = 0
    children = []
    for _ in range(rng.randrange(1, 5)):
        words = " ".join(rng.choice(["one", "two,", "three.", "four!"]) for _ in range(rng.choice([1, 5, 40])))
        leaf = {"ul": "li", "table": "caption"}.get(tag) or rng.choice(["p", "p", "h1", "h2", "pre", "div"])
        if depth < 4 and tag not in ("ul", "table") and rng.random() < 0.5:
            children.append(random_tree(rng, depth + 1))
        elif rng.random() < 0.25:
            children.append((leaf, "", 0, [("a", "", 0, [words])]))
        else:
            children.append((leaf, "", 0, [words]))
    return tag, name, mark, children


def render(node):
    return node if isinstance(node, str) else f"<{node[0]} {node[1]}>{''.join(map(render, node[3]))}</{node[0]}>"


def test_equals_the_plain_method():
    import random

    rng = random.Random(11)
    some = 0
    for _ in range(1500):
        tree = random_tree(rng)
        want = plain_main(plain_blocks(tree))
        assert main_text(render(tree)) == want, render(tree)
        some += bool(want)
    assert some > 1000
