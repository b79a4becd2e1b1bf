"""Conversation repair against all edits, and in pieces against whole walks."""

import hashlib
import itertools
import random
import zlib

import pytest

from emberlens.llm import conversations, queries

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def faults(rows):
    """Rows of one conversation in order: (role, text, fault)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return rows, out


def roles_of(allowed):
    """The one sequence of initials (s?(ua)+)? that takes one of each set, if there is one."""
    for head in ("", "s"):
        want = head + "ua" * ((len(allowed) - len(head)) // 2)
        if len(want) == len(allowed) and want != "s" and all(w in a for w, a in zip(want, allowed, strict=True)):
            return want
    return None


def by_force(rows):
    """Every sequence of edits with up to two inserted rows between others."""
    best = None
    for plan in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, _, f) in zip(plan, rows, strict=True)):
            continue
        for gaps in itertools.product((0, 1, 2), repeat=len(rows) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, plan, strict=False)) + "I" * gaps[-1]
            cost = sum({"D": 2, "R": 1}.get(e, 0) + (5 if f == "truncated" and e != "D" else 0) for e, (_, _, f) in zip(plan, rows, strict=True)) + 5 * sum(gaps)
            if best is not None and (cost, audit) >= best[:2]:
                continue
            at, allowed, kept = 0, [], []
            for letter in audit:
                if letter != "D":
                    allowed.append(rows[at][0][:1] if letter == "K" else "ua")
                    kept.append((rows[at][0] if letter == "K" else None, "" if letter == "I" else rows[at][1]))
                at += letter != "I"
            roles = roles_of(allowed)
            if roles is not None:
                names = {"u": "user", "a": "assistant"}
                best = cost, audit, "\n".join(f"{r if r is not None else names[w]}:{t}" for (r, t), w in zip(kept, roles, strict=True))
    return best


def expected(every, rows, solve):
    out = []
    for conv in {r[0] for r in every}:
        own, marked = faults([r for r in rows if r[0] == conv])
        turns = {r[1] for r in own} - {None}
        initials = [r[:1] for r, _, _ in marked]
        cost, audit, text = solve(marked) if marked else (0, "", "")
        count = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def made(rng, conv, n):
    texts = ["Yes.", "No!", "Why?", "It is so", "and then", "", " \n", "One. Two", "Done.\t", "x .", ". ", "ok"]
    return [(conv, k if rng.random() < 0.9 else rng.randrange(n), rng.choice(("user", "assistant", "assistant", "user", "system", "tool", "")), rng.choice(texts) + (str(k) + "." if rng.random() < 0.4 else "")) for k in range(n)]


COLUMNS = "conv_id long, turn long, role string, text string"


def test_edits_are_the_cheapest_and_least():
    rng = random.Random(2)
    for k in range(60):
        _, marked = faults(made(rng, k, rng.choice((1, 2, 3, 4))))
        rows = [({"": 0, "truncated": 1}.get(f, 2), r[:1], 1) for r, _, f in marked]
        ((_, (cost, audit)),) = conversations.edits(rows, 0, tail=True).items()
        letters, kept = conversations.applied(rows, [(r, t) for r, t, _ in marked], audit, 0)
        assert (cost, letters, "\n".join(f"{r['role']}:{r['text']}" for r in kept)) == by_force(marked)


def whole(marked):
    """The walk over a conversation that is held at once."""
    rows = [({"": 0, "truncated": 1}.get(f, 2), r[:1], 1) for r, _, f in marked]
    ((_, (cost, audit)),) = conversations.edits(rows, 0, tail=True).items()
    letters, kept = conversations.applied(rows, [(r, t) for r, t, _ in marked], audit, 0)
    return cost, letters, "\n".join(f"{r['role']}:{r['text']}" for r in kept)


def test_rows_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [r for k in range(40) for r in made(rng, k, rng.choice((1, 2, 3, 4)))]
    rows += [(None, 0, "user", "Hi."), (None, None, None, "x."), (None, 3, "assistant", None), (90, None, "user", None), (91, 5, "user", "Same."), *[(92, 1, "user", "Same.")] * 700, (92, 2, "assistant", "Fine.")]
    frame = spark.createDataFrame([(*r, 7, "x") for r in rows], COLUMNS + ", rank long, digest string").repartition(5)
    assert sorted((tuple(r) for r in conversations.repaired(frame).collect()), key=str) == expected(rows, damaged(rows), whole)
    assert conversations.repaired(frame.where("conv_id < 0")).count() == 0


def test_a_conversation_in_many_pieces(spark, monkeypatch):
    """Pieces of 8 rows in groups of 3: the same edits as in one walk; through Spark, over several tasks."""
    rng = random.Random(9)
    rows = [(k % 3, j, role, text) for k in range(3) for j, (_, _, role, text) in enumerate(made(rng, k, (700, 90, 5)[k]))]
    marked = conversations.with_faults(conversations.counted(spark.createDataFrame(rows, COLUMNS)))
    monkeypatch.setattr(conversations, "PIECE", 8)
    monkeypatch.setattr(conversations, "FAN", 3)
    held = marked.persist()
    walk = conversations._Walk(0)
    order = sorted(held.collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.digest))
    for r in order:
        walk.add((r.conv_id,), r.role, r.text, r.n, r.blank or r.seen, r.truncated)
    walk.close(True)
    assert sum(not r["whole"] for _, r in walk.out) > 90
    for conv in range(3):
        pieces = [r for c, r in walk.out if c == conv]
        if pieces[0]["whole"]:
            continue
        tables = [(r["prices"], r["ranks"]) for r in pieces]
        groups = tables
        while len(groups) > 1:  # in groups of groups, as the rounds do
            parts = [groups[i : i + 3] for i in range(0, len(groups), 3)]
            groups = [(sum((conversations.follow(e, p)[0] for e in range(4)), []), sum((conversations.follow(e, p)[1] for e in range(4)), [])) for p in parts]
        cost, order4, came = conversations.follow(0, tables)
        assert groups[0][0][:4] == cost and [groups[0][1][s] for s in range(4) if cost[s] < conversations.NEVER] == [order4[s] for s in range(4) if cost[s] < conversations.NEVER]
    want = expected(rows, rows, whole)
    assert sorted((tuple(r) for r in conversations.judged(conversations.counted(spark.createDataFrame(rows, COLUMNS).repartition(4))).collect()), key=str) == want


def test_walks_of_any_cut_agree():
    """Costs and audits through piece tables equal those of one walk."""
    rng = random.Random(12)
    for _ in range(30):
        rows = [(rng.choice((0, 0, 1, 2)), rng.choice("suat"), rng.choice((1, 1, 3))) for _ in range(rng.randrange(1, 40))]
        rows = [(k, i, n if k == 2 else 1) for k, i, n in rows]
        ((_, (cost, audit)),) = conversations.edits(rows, 0, tail=True).items()
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows) + 1) for _ in range(4))})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        prices, order, came = conversations.follow(0, [conversations.tables(p) for p in parts])
        end = min((prices[s] + (0, 10, 5, 0)[s], order[s], s) for s in range(4))
        state, path = end[2], []
        for back in reversed(came):
            path.append((back[state], state))
            state = back[state]
        letters = "".join(conversations.edits(p, a, tail=False)[b][1] for p, (a, b) in zip(parts, reversed(path), strict=True))
        assert (end[0], letters + ("", "II", "I", "")[end[2]]) == (cost, audit)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query_equals_its_sql(spark, folder):
    import os

    import duckdb

    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = db.sql(queries.ORACLES["op12_conversation_repair"])
    got = queries.QUERIES["op12_conversation_repair"](spark, folder)
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(want.fetchall())
