"""Page trees and subtree sums against the standard library's parser and recursion."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from emberlens.operators import pages, trees
from emberlens.sources import html


class Parser(HTMLParser):
    """Elements of well-formed pages: name, parent, depth, attributes."""

    def __init__(self):
        super().__init__()
        self.out, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        self.out.append((tag, self.stack[-1] if self.stack else None, len(self.stack), dict(attrs)))
        if tag not in html.VOID:
            self.stack.append(len(self.out) - 1)

    def handle_startendtag(self, tag, attrs):
        self.out.append((tag, self.stack[-1] if self.stack else None, len(self.stack), dict(attrs)))

    def handle_endtag(self, tag):
        assert self.out[self.stack.pop()][0] == tag


def page(rng, depth=0):
    tag = rng.choice(("div", "span", "ul", "section", "b"))
    parts = [f"<{tag}", rng.choice(("", ' id="x"', " data-a='1 > 0'", ' class="a b"', " checked", ' x=1')), ">"]
    for _ in range(rng.randrange(0, 4)):
        parts.append(rng.choice(("words ", "<!-- <b> no -->", "<br>", '<img src="a>b.png"/>', "<script>if (a<b) x('</p>')</script>", "ü ")) if depth > 3 or rng.random() < 0.5 else page(rng, depth + 1))
    return "".join([*parts, f"</{tag.upper() if rng.random() < 0.2 else tag}>"])


def test_elements_equal_the_library_parser():
    for k in range(150):
        text = page(random.Random(k))
        parser = Parser()
        parser.feed(text)
        got = html.elements(text)
        assert [(e["name"], e["parent"], e["depth"], dict(e["attrs"])) for e in got] == parser.out
        for e in got:
            below = [x["n"] for x in got if x["n"] == e["n"] or x["parent"] is not None and any(a == e["n"] for a in ancestors(got, x["n"]))]
            assert below == list(range(e["n"], e["last"] + 1))


def ancestors(rows, n):
    while (n := rows[n]["parent"]) is not None:
        yield n


def test_implied_ends_and_broken_pages():
    shape = lambda text: [(e["name"], e["depth"]) for e in html.elements(text)]
    assert shape("<div><p>a<p><b>c<div>d</div></div>") == [("div", 0), ("p", 1), ("p", 1), ("b", 2), ("div", 1)]
    assert shape("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == [("ul", 0), ("li", 1), ("li", 1), ("ul", 2), ("li", 3), ("li", 1)]
    assert shape("<table><tr><td>1<td>2<tr><th>3</table>x") == [("table", 0), ("tr", 1), ("td", 2), ("td", 2), ("tr", 1), ("th", 2)]
    assert shape("</p><b><i>x</b>y<u>") == [("b", 0), ("i", 1), ("u", 0)]
    assert shape("<!-- <b> never closed") == [] and shape("") == [] and shape("a < b > c <3") == []
    assert [e["text_bytes"] for e in html.elements("<p>é<b>xy</b>z</p>tail")] == [3, 2]
    assert html.attributes(" A=1 b='x \"y' c=\"<d>\" e A=2 f = g") == {"a": "2", "b": 'x "y', "c": "<d>", "e": None, "f": "g"}


def test_image_rules(spark):
    cases = {
        "sized": ['<img width=10 height="5">', '<img src=a style="width: 10px; HEIGHT:2em">', '<img width="{{ w }}" style="aspect-ratio: 1">', "<img width=' 3px' height='2'>", '<img style="width:auto;width:1px;height:1px">'],
        "bare": ["<img>", "<img width=10>", '<img width="+1" height="x">', '<img style="width:auto;height:1px">', '<img style="max-width:1px;max-height:1px">', '<img width height>'],
        "exempt": ['<img src=" DATA:image/svg+xml;x">', '<img style="position : Absolute">'],
    }
    rows = [(k, v, i) for k, (v, texts) in enumerate(cases.items()) for i in texts]
    frame = spark.createDataFrame([(n, v, i) for n, (_, v, i) in enumerate(rows)] + [(90, "", None), (91, "", "<!-- <img> -->"), (92, "bare", '<img class="x">')], "id long, verdict string, html string")
    got = {r.id: (r.verdict, r.confidence) for r in pages.unsized(html.nodes(frame, "id", "html"), "id").collect()}
    assert got == {r.id: (r.verdict, ("low" if r.id == 92 else "medium") if r.verdict == "bare" else None) for r in frame.collect() if r.verdict}
    every = {r.id: (r.images, r.status) for r in pages.images_without_size(frame, html.nodes(frame, "id", "html"), "id").collect()}
    assert len(every) == frame.count() and every[90] == every[91] == (0, "clean")
    lazy = ['<img class="a lazyload" data-src=1>', '<img class="lozad" data-src=1 loading=LAZY>', '<img class="lazyloads" data-src=1>', '<img class="lazy">', '<img data-src=2 class="\n lazy\t">']
    found = pages.lazy_images(html.nodes(spark.createDataFrame(list(enumerate(lazy)), "id long, html string"), "id", "html"), "id").collect()
    assert sorted(r.id for r in found) == [0, 4]
    scripts = spark.createDataFrame([(1, '<script src="/js/Lazysizes.min.js"></script><script>"lozad"</script>'), (2, "<script src=app.js></script>")], "id long, html string")
    assert [(r.id, r.library) for r in pages.library_scripts(html.nodes(scripts, "id", "html"), "id").collect()] == [(1, "lazysizes")]


def sums_by_recursion(parent, weight):
    out = dict.fromkeys(parent, 0)
    for x in parent:
        up, seen = x, set()
        while up in parent and up not in seen:
            seen.add(up)
            out[up] += weight[x]
            up = parent[up]
    return out


def test_subtree_sums(spark):
    rng = random.Random(3)
    for n, shape in ((1, lambda k: None), (400, lambda k: k - 1 if k else None), (300, lambda k: rng.randrange(k) if k else None), (50, lambda k: None if k % 7 == 0 else k - 1), (9, lambda k: k + 100)):
        parent, weight = {k: shape(k) for k in range(n)}, {k: rng.randrange(10) for k in range(n)}
        frame = spark.createDataFrame([(1, k, parent[k], weight[k]) for k in parent] + [(2, 0, None, 5), (2, 1, 0, 6)], "t long, n long, up long, w long")
        rows = trees.subtree_by_doubling(frame, ["t", "n"], "up", "w", "total").collect()
        assert {r.n: r.total for r in rows if r.t == 1} == sums_by_recursion(parent, weight)
        assert {r.n: r.total for r in rows if r.t == 2} == {0: 11, 1: 6}
    # a cycle, what hangs on it, and a sound tree beside it
    frame = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 2, 1), (4, None, 1), (5, 4, 1)], "n long, up long, w long")
    assert {r.n: r.total for r in trees.subtree_by_doubling(frame, ["n"], "up", "w", "total").collect()} == {1: None, 2: None, 3: None, 4: 2, 5: 1}
    texts = spark.createDataFrame([(k, page(random.Random(k))) for k in range(20)] + [(None, "<p>a<b>b</b></p>")], "id long, html string")
    rows = trees.subtree_by_interval(html.nodes(texts, "id", "html"), "id", "text_bytes", "bytes").collect()
    for key in {r.id for r in rows}:
        own = {r.n: r for r in rows if r.id == key}
        assert {n: r.bytes for n, r in own.items()} == sums_by_recursion({n: r.parent for n, r in own.items()}, {n: r.text_bytes for n, r in own.items()})


def test_heap_profile_credits_builtins_to_their_caller(spark):
    """(root) -> app.js:10 -> map -> JSON.parse; app.js:10 -> module -> builtin; (root) -> builtin."""
    frames = [(1, None, "", 0, 5), (2, 1, "file:///app.js", 9, 100), (3, 2, "", 0, 200), (4, 3, None, 0, 300), (5, 2, "node:internal", 3, 70), (6, 5, "", 0, 80), (7, 1, "", 0, 90), (8, 2, "file:///app.js", 9, 1), (9, 8, "file:///lib.js", 0, 4)]
    rows = spark.createDataFrame([("a", *f) for f in frames], "profile string, n long, up long, url string, line long, size long").withColumn("at", F.col("line") + 1)
    got = trees.owned_bytes(rows, ["profile", "n"], "up", F.col("url"), F.col("url").startswith("node:"), ["url", "at"], "size", 5).collect()
    assert [(r.url, r["at"], r.allocated_bytes) for r in got] == [("file:///app.js", 10, 601)]
