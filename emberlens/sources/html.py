"""HTML as relations: a row for each element, with its parent, depth, attributes and the interval of elements below it.

Tags are found by one pattern that passes over comments, declarations and the contents of raw elements, and knows quoted
attribute values. A close tag ends the innermost open element of its name and all within it; without one it means nothing.
Some start tags end an open paragraph, item or cell that they can't stand in, with the inline elements open in it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea)\b(?P<raw_attrs>{ATTRIBUTES})>(?P<body>.*?)(?:</(?P=raw)\s*>|\Z)|</(?P<end>[a-z][^\s/>]*)[^>]*>|<(?P<start>[a-z][^\s/>]*)(?P<attrs>{ATTRIBUTES})>|<[!?][^>]*>""", re.I | re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
# Elements without content, inline elements, and the start tags that end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd label mark q s samp small span strong sub sup tt u var".split())
_BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
ENDED_BY = {
    "p": _BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "thead": frozenset(["tbody", "tfoot"]), "tbody": frozenset(["tbody", "tfoot"]),
}
NODE = pa.struct([("n", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("begin", pa.int32()), ("last", pa.int32()), ("text_bytes", pa.int64())])


def attributes(text: str) -> dict[str, str | None]:
    """Values by lower-cased name; the last of equal names counts, and a name without a value has null."""
    return {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), None) for m in ATTRIBUTE.finditer(text.rstrip("/") if text.endswith(" /") else text)}


def elements(html: str) -> list[dict]:
    """The elements of one page in the order of their start tags; ``last`` is the last one within, ``text_bytes`` what stands directly in it."""
    out: list[dict] = []
    stack: list[int] = []
    at = 0

    def text(upto: int) -> None:
        if stack and upto > at:
            out[stack[-1]]["text_bytes"] += len(html[at:upto].encode())

    def leave(keep: int) -> None:
        while len(stack) > keep:
            out[stack.pop()]["last"] = len(out) - 1

    def enter(name: str, attrs: str, begin: int) -> None:
        while True:
            top = next((k for k in range(len(stack) - 1, -1, -1) if out[stack[k]]["name"] not in INLINE), None)
            if top is None or name not in ENDED_BY.get(out[stack[top]]["name"], ()):
                break
            leave(top)
        out.append({"n": len(out), "parent": stack[-1] if stack else None, "depth": len(stack), "name": name, "attrs": list(attributes(attrs).items()), "begin": begin, "last": len(out), "text_bytes": 0})

    for m in TOKEN.finditer(html):
        text(m.start())
        at = m.end()
        if m["raw"]:
            enter(m["raw"].lower(), m["raw_attrs"], m.start())
            out[-1]["text_bytes"] = len(m["body"].encode())
        elif m["start"]:
            name = m["start"].lower()
            enter(name, m["attrs"], m.start())
            if name not in VOID and not m["attrs"].endswith("/"):
                stack.append(len(out) - 1)
        elif m["end"]:
            name = m["end"].lower()
            found = next((k for k in range(len(stack) - 1, -1, -1) if out[stack[k]]["name"] == name), None)
            if found is not None:
                leave(found)
    text(len(html))
    leave(0)
    return out


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, n, parent (null at the top), depth, name, attrs, begin (character), last and text_bytes; a null page has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                page = batch.column(1)[i].as_py()
                rows = pa.array(elements(page) if page else [], NODE)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), *rows.flatten()], names=[key, *(f.name for f in NODE)])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, F.col(html).cast("string")).mapInArrow(run, f"{key} {kind}, n int, parent int, depth int, name string, attrs map<string,string>, begin int, last int, text_bytes long")
