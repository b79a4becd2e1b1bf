"""Token alignment against plain Python."""

import hashlib
from collections import defaultdict

import pytest
from odd_rows import ODD, rich

from emberlens.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def tokens(text):
    """Ids with bytes of both sides, by the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    tool = tokens.__dict__.setdefault("a", Tokenizer.from_file(A))
    tool.encode_special_tokens = True
    pieces = tokens.__dict__.setdefault("b", sentencepiece.SentencePieceProcessor(model_file=B))
    table = byte_table()
    got = tool.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(table[c] for c in p)) for i, p in zip(got.ids, got.tokens, strict=True)]
    b = [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, pieces.id_to_piece(i)) for i in pieces.encode(text))]
    return a, b


def groups(text):
    if not text:
        return []
    a, b = tokens(text)
    raw = (" " + text).encode()
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return []
    ends = []
    for side in (a, b):
        at, out = 0, {}
        for i, x in side:
            at += len(x)
            out[at] = i
        ends.append(out)
    found, now = [], ([], [])
    for at in range(1, len(raw) + 1):
        for side, held in zip(ends, now, strict=True):
            if at in side:
                held.append(side[at])
        if at in ends[0] and at in ends[1]:
            found.append(now)
            now = ([], [])
    return found


def by_force(docs):
    each = [(i, groups(t)) for i, t in docs]
    count = defaultdict(int)
    for _, gs in each:
        for pair in {(x, y) for a, b in gs for x in a for y in b}:
            count[pair] += 1
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for i, gs in each:
        links = [(x, y) for a, b in gs for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in gs)
        out.append((i, sum(len(a) for a, _ in gs), sum(len(b) for _, b in gs), len(gs), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


MORE = [
    (20, "plain <|endoftext|> and </s> <unk> text"), (21, "a▁b"), (22, "x\x00y\x1c  \t\n\n  z"), (23, "ﬁ é 漢字かな \U0001f600\U0001f600‍x"), (24, " " * 37), (25, "    def f():\n        return 1\n"),
    (26, "a" * 300), (27, "日本語" * 40), (28, rich(1, 400)), (29, "Ünïcödé ÄÖÜ ßẞ"), (None, "no id"), (20, "again"), (30, "."), (31, "﻿mark"),
]


def test_alignment_equals_plain_python(spark, odd, nothing, monkeypatch):
    docs = [*ODD, ODD[11]]
    assert sorted((tuple(r) for r in alignment.align(odd, A, B).collect()), key=str) == by_force(docs)
    frame = spark.createDataFrame([(*r, 1, "k") for r in MORE], "doc_id long, text string, block long, kinds string").repartition(3)
    want = by_force(MORE)
    assert sorted((tuple(r) for r in alignment.align(frame, A, B).collect()), key=str) == want
    assert [r[1:5] for r in want if r[0] == 21] == [(0, 0, 0, 0)] and sum(r[4] for r in want) > sum(r[3] for r in want)
    assert alignment.align(nothing, A, B).count() == 0


def test_long_texts_are_cut_where_nothing_changes(monkeypatch):
    tools = alignment.tokenizers_of(A, B)
    text = " ".join(t or "" for _, t in [*ODD, *MORE]) + " end "
    whole = tools.b_ids(text)
    for size in (5, 64, 1000):
        monkeypatch.setattr(alignment, "LONG", size)
        assert tools.b_ids(text) == whole


def test_blocks_of_any_size_agree():
    """The pairs of several blocks sum to those of one."""
    import pyarrow as pa

    tools, texts = alignment.tokenizers_of(A, B), [t for _, t in [*ODD, *MORE]]

    def pairs(parts):
        out = defaultdict(int)
        for part in parts:
            block = alignment.Block(tools)
            for k in range(0, len(part), 4):
                block.add(pa.array(range(len(part[k : k + 4]))), part[k : k + 4])
            a, b, n = next(c for sort, c in block.held() if sort == "pairs")
            for x, y, z in zip(a.to_pylist(), b.to_pylist(), n.to_pylist(), strict=True):
                out[x, y] += z
        return out

    assert pairs([texts]) == pairs([texts[:9], texts[9:10], texts[10:]])
