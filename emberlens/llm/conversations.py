"""Conversation structure repair: the cheapest edits that make the turns of a conversation ``(system)? (user assistant)+``.

Faults are relations: equal rows of a turn are one row with a count, a row is a duplicate where the first turn of its role
and text is an earlier one, and counts are grouped sums. The edits of a conversation are a path through a lattice of
(rows read, state), a state being what the kept roles end in. A* walks it: a row costs 0 to keep, 1 to give the role that
is due, 2 to delete, an inserted row 5, and a truncated row that stays 5 more. The heuristic is the suffix sum of
what is unavoidable: 2 for each blank or duplicate row (they must go) and 2 for each truncated one (it goes, or costs 5).
It is consistent, and the queue is keyed by (cost plus heuristic, audit), so each state is first reached by its cheapest
edits and, of these, by the least audit, whatever their number.

A range sort by conversation and turn lets a task walk its conversations as a stream. Where one is cut by a task's end
or holds more than ``PIECE`` rows, its pieces are solved for every state in which they can begin and end: costs, and how the
audits of one beginning compare. Such tables combine associatively, in groups of ``FAN`` pieces, groups of groups and so
on; then the states are handed down again and each piece is walked once more between its own two. So no task ever holds a
whole conversation, however long. Only a SHA-256 over all of it is serial by nature: a task streams its pieces in order.

Defined results: a null role or text is one space, and so is a null in a turn's key; rows of equal turn go by role, then by
the SHA-256 of the text; rows without turn come first; an empty role has no initial; rows without a conv_id are one
conversation; equal rows are duplicates of each other; very long texts are moved but never compared as a whole; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tune

SPACES = "\x20\t\n\x0b\x0c\r"
#: Elements and characters of a piece, and pieces or groups of a group.
PIECE, PIECE_CHARS, FAN = 1024, 1 << 20, 512
#: What a row is to the walk.
WHOLE, TRUNCATED, GONE = range(3)
#: States: nothing kept yet, a system row, a user row, an assistant row. What a kept initial leads to, and the role that is due.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
DUE = (2, 2, 3, 2)
ROLE = (None, None, "user", "assistant")
DONE = (0, 3)
NEVER = 1 << 60


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage of the contract, equal rows as one with their number ``n``."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return counted(rows)


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows as one: conv_id, turn, role, text and their number ``n``, which rows may have."""
    n = F.sum("n") if "n" in rows.columns else F.count("*")
    return rows.groupBy("conv_id", "turn", "role", "text").agg(n.cast("long").alias("n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``counted`` rows plus digest, blank, seen (role and text stand in an earlier turn or row) and truncated, the first two ruling out what follows."""
    stripped = F.rtrim("text", F.lit(SPACES))
    rows = rows.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).withColumn("blank", stripped == "").withColumn("open", ~F.right(stripped, F.lit(1)).isin(".", "!", "?"))
    place = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("at"))
    first = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("first"))
    joined = rows.join(first, rows["conv_id"].eqNullSafe(first["c"]) & (rows["role"] == first["r"]) & (rows["digest"] == first["d"]))
    seen = ~F.col("blank") & ~place.eqNullSafe(F.col("first"))
    out = joined.select("conv_id", "turn", "role", "text", "n", "digest", "blank", seen.alias("seen"), "open")
    return out.withColumn("truncated", ~F.col("blank") & ~F.col("seen") & F.col("open")).drop("open")


def edits(rows: list[tuple], entry: int, tail: bool) -> dict[int, tuple[int, str]]:
    """The cheapest edits of rows (kind, initial, times) that begin in state ``entry``: cost and least audit by the state in which they end.

    With ``tail``, rows may be inserted at the end and only the best valid end is returned. A run of rows that must go is one
    letter. Rows are never inserted before a deleted one: the same edits in the other order have the lesser audit."""
    rest = [0]
    for kind, _, times in reversed(rows):
        rest.append(rest[-1] + (0 if kind == WHOLE else 2 * times))
    rest.reverse()
    queue, closed, found = [(rest[0], "", 0, 0, entry)], set(), {}
    while queue:
        _, audit, cost, at, state = heapq.heappop(queue)
        if (at, state) in closed:
            continue
        closed.add((at, state))
        steps = []
        if at == len(rows):
            if not tail:
                found[state] = (cost, audit)
                continue
            if state in DONE:
                return {state: (cost, audit)}
            steps.append((5, "I", at, DUE[state]))
        else:
            kind, initial, times = rows[at]
            if kind == GONE:
                steps.append((2 * times, "D", at + 1, state))
            else:
                stays = 5 if kind == TRUNCATED else 0
                steps += [(2, "D", at + 1, state), (1 + stays, "R", at + 1, DUE[state]), (5, "I", at, DUE[state])]
                if initial in STEPS[state]:
                    steps.append((stays, "K", at + 1, STEPS[state][initial]))
        for price, letter, i, s in steps:
            if (i, s) not in closed:
                heapq.heappush(queue, (cost + price + rest[i], audit + letter, cost + price, i, s))
    return found


def applied(rows: list[tuple], texts: list[tuple[str, str]], audit: str, state: int) -> tuple[str, list[dict]]:
    """The audit with a letter for each row, and the repaired rows (role, text)."""
    letters, out, at = [], [], 0
    for letter in audit:
        if letter == "D":
            letters.append("D" * rows[at][2])
        else:
            letters.append(letter)
            role, text = texts[at] if letter != "I" else ("", "")
            after = STEPS[state][rows[at][1]] if letter == "K" else DUE[state]
            out.append({"role": role if letter == "K" else ROLE[after], "text": text})
            state = after
        at += letter != "I"
    return "".join(letters), out


def tables(rows: list[tuple]) -> tuple[list[int], list[int]]:
    """Costs from each state to each, and for each beginning how the audits of the ends compare."""
    cost, order = [NEVER] * 16, [0] * 16
    for entry in range(4):
        found = edits(rows, entry, tail=False)
        for k, state in enumerate(sorted(found, key=lambda s: found[s][1])):
            cost[4 * entry + state], order[4 * entry + state] = found[state][0], k
    return cost, order


def follow(entry: int, pieces: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int], list[list[int]]]:
    """Costs and order of the ends of consecutive pieces that begin in ``entry``, and from where each state is reached, piece by piece.

    Audits of equal pieces that end in different states differ before either ends, so their order decides."""
    cost, order, came = [0 if s == entry else NEVER for s in range(4)], [0] * 4, []
    for price, rank in pieces:
        keys = [min((cost[e] + price[4 * e + s], order[e], rank[4 * e + s], e) if max(cost[e], price[4 * e + s]) < NEVER else (NEVER, 0, 0, e) for e in range(4)) for s in range(4)]
        cost, came = [k[0] for k in keys], [*came, [k[3] for k in keys]]
        place = sorted(range(4), key=lambda s: keys[s][1:3])
        order = [place.index(s) for s in range(4)]
    return cost, order, came


class _Walk:
    """The conversations of a task's sorted rows: the first and the last may go on in another task."""

    FIELDS = ("part", "whole", "illegal", "head", "last", "cost", "audit", "rows", "prices", "ranks", "kinds", "times")
    SCHEMA = "part long, whole boolean, illegal long, head string, last string, cost long, audit string, rows array<struct<role: string, text: string>>, prices array<long>, ranks array<int>, kinds array<int>, times array<long>"

    def __init__(self, task: int) -> None:
        self.next, self.out, self.bytes = task << 32, [], 0
        self.conv, self.first = None, True
        self.begin()

    def begin(self) -> None:
        self.cut = self.first
        self.open()

    def open(self) -> None:
        self.rows, self.texts, self.chars, self.illegal, self.head, self.last = [], [], 0, 0, None, None

    def add(self, conv: tuple, role: str, text: str, n: int, gone: bool, truncated: bool) -> None:
        if conv != self.conv:
            self.close(False)
            self.conv = conv
        elif len(self.rows) >= PIECE or self.chars >= PIECE_CHARS:
            self.cut = True
            self.piece()
            self.open()
        initial = role[:1]
        if self.last is not None:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.head = initial
        self.illegal += n - 1
        self.last = initial
        if not gone:
            self.rows.append((TRUNCATED if truncated else WHOLE, initial, 1))
            self.texts.append((role, text))
            self.chars += len(text)
        if n - (not gone):
            self.rows.append((GONE, initial, n - (not gone)))
            self.texts.append(("", ""))

    def close(self, end: bool) -> None:
        """The current conversation ends here, or at the task's ``end`` may go on."""
        if self.conv is not None:
            if self.cut or end:
                self.piece()
            else:
                ((_, (cost, audit)),) = edits(self.rows, 0, tail=True).items()
                # what is inserted at the end comes after all rows
                letters, kept = applied(self.rows, self.texts, audit, 0)
                self.put(whole=True, cost=cost, audit=letters, rows=kept)
            self.first = False
        self.begin()

    def piece(self) -> None:
        prices, ranks = tables(self.rows)
        rows = [{"role": r, "text": t} for r, t in self.texts]
        self.put(whole=False, rows=rows, prices=prices, ranks=ranks, kinds=[k for k, _, _ in self.rows], times=[n for _, _, n in self.rows])

    def put(self, **values) -> None:
        row = dict.fromkeys(self.FIELDS) | {"part": self.next, "illegal": self.illegal, "head": self.head, "last": self.last} | values
        self.out.append((self.conv[0], row))
        self.bytes += self.chars + 300
        self.next += 1

    def batch(self, like: pa.DataType, schema: pa.Schema) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([c for c, _ in self.out], like), *(pa.array([r[f] for _, r in self.out], schema.field(f).type) for f in self.FIELDS)], names=["conv_id", *self.FIELDS])
        self.out, self.bytes = [], 0
        return out


_PARTS = pa.schema([("part", pa.int64()), ("whole", pa.bool_()), ("illegal", pa.int64()), ("head", pa.string()), ("last", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("prices", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32())), ("times", pa.list_(pa.int64()))])


def walked(rows: DataFrame) -> DataFrame:
    """The conversations of rows ``with_faults`` that a task holds whole, repaired, and the pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, like = _Walk(TaskContext.get().partitionId()), None
        for batch in batches:
            like = batch.column(0).type
            columns = [batch.column(k).to_pylist() for k in range(6)]
            for conv, *rest in zip(*columns, strict=True):
                walk.add((conv,), *rest)
                if walk.bytes > PIECE_CHARS:
                    yield walk.batch(like, _PARTS)
        if like is not None:
            walk.close(True)
            yield walk.batch(like, _PARTS)

    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.col("turn").isNotNull(), "turn", "role", "digest"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "n", (F.col("blank") | F.col("seen")).alias("gone"), "truncated")
    return rows.mapInArrow(run, f"conv_id {kind}, {_Walk.SCHEMA}")


def _combined(pdf):
    import pandas as pd

    pdf = pdf.sort_values("k")
    pieces = [([int(x) for x in p], [int(x) for x in r]) for p, r in zip(pdf.prices, pdf.ranks, strict=True)]
    prices, ranks = [], []
    for entry in range(4):
        cost, order, _ = follow(entry, pieces)
        prices, ranks = prices + cost, ranks + order
    return pd.DataFrame({"conv": [pdf.conv.iloc[0]], "k": [pdf.k.iloc[0] // FAN], "prices": [prices], "ranks": [ranks]})


def _handed_down(key, pdf, above):
    import pandas as pd

    pdf = pdf.sort_values("k")
    pieces = [([int(x) for x in p], [int(x) for x in r]) for p, r in zip(pdf.prices, pdf.ranks, strict=True)]
    _, _, came = follow(int(above.entry.iloc[0]), pieces)
    state, exits = int(above.leave.iloc[0]), []
    entries = []
    for back in reversed(came):
        exits.append(state)
        state = back[state]
        entries.append(state)
    return pd.DataFrame({"conv": pdf.conv, "k": pdf.k, "entry": entries[::-1], "leave": exits[::-1], "total": above.total.iloc[0], "n": above.n.iloc[0]})


def between(pieces: DataFrame) -> DataFrame:
    """conv, k, and the states between which each piece lies on its conversation's best path, with the path's cost and the number of pieces.

    pieces: conv, k (from 0 within conv), prices, ranks."""
    node = "conv long, k long, prices array<long>, ranks array<int>"
    levels = [pieces]
    while not levels[-1].where("k > 0").isEmpty():
        up = levels[-1].groupBy("conv", F.floor(F.col("k") / FAN)).applyInPandas(_combined, node)
        levels.append(materialize(up, "conversations-level"))
    sizes = pieces.groupBy("conv").agg(F.count("*").alias("n"))
    # a path ends in a state where it may stop, or inserts what is due
    ends = [F.struct((F.element_at("prices", s + 1) + (0, 10, 5, 0)[s]).alias("total"), F.element_at("ranks", s + 1).alias("rank"), F.lit(s).alias("leave")) for s in range(4)]
    best = levels[-1].withColumn("end", F.array_min(F.array(*ends))).join(sizes, "conv")
    down = best.select("conv", F.lit(0).cast("long").alias("k"), F.lit(0).alias("entry"), "end.leave", "end.total", "n")
    for level in reversed(levels[:-1]):
        above = down.withColumnRenamed("k", "up")
        own = level.withColumn("up", F.floor(F.col("k") / FAN))
        down = materialize(own.groupBy("conv", "up").cogroup(above.groupBy("conv", "up")).applyInPandas(_handed_down, "conv long, k long, entry int, leave int, total long, n long"), "conversations-states")
    return down


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces between their states; the last one of a conversation gets what is due at the end."""
    for batch in batches:
        audits, kept = [], []
        for row in batch.select(["rows", "kinds", "times", "entry", "leave", "tail"]).to_pylist():
            rows = [(k, r["role"][:1], n) for k, r, n in zip(row["kinds"], row["rows"], row["times"], strict=True)]
            letters, out = applied(rows, [(r["role"], r["text"]) for r in row["rows"]], edits(rows, row["entry"], tail=False)[row["leave"]][1], row["entry"])
            state = row["leave"]
            while row["tail"] and state not in DONE:
                state = DUE[state]
                letters, out = letters + "I", [*out, {"role": ROLE[state], "text": ""}]
            audits.append(letters)
            kept.append(out)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "illegal", "head", "last", "cost")), pa.array(audits, pa.string()), pa.array(kept, _PARTS.field("rows").type)], names=["conv_id", "part", "illegal", "head", "last", "cost", "audit", "rows"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that were walked at once, and the parts in order of the others; both: conv_id, part, illegal, head, last, cost, audit, rows (role, text).

    rows: ``with_faults``. illegal counts neighbours within the part, head and last are its outermost initials before repair."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    held = materialize(walked(rows), "conversations-walked")
    columns = ["conv_id", "part", "illegal", "head", "last", "cost", "audit", "rows"]
    pieces = held.where("NOT whole")
    # a conversation is named by its first piece
    names = pieces.groupBy("conv_id").agg(F.min("part").alias("conv")).withColumnRenamed("conv_id", "_id")
    named = pieces.select("conv_id", "part", "prices", "ranks").join(names, pieces["conv_id"].eqNullSafe(F.col("_id"))).drop("_id", "conv_id")
    named = materialize(named.withColumn("k", (F.row_number().over(Window.partitionBy("conv").orderBy("part")) - 1).cast("long")), "conversations-pieces")
    states = between(named.select("conv", "k", "prices", "ranks")).join(named.select("conv", "k", "part"), ["conv", "k"])
    states = states.select("part", "entry", "leave", F.col("total").alias("_cost"), (F.col("k") == F.col("n") - 1).alias("tail"))
    full = pieces.drop("cost").join(states, "part").withColumnRenamed("_cost", "cost")
    split = full.select("conv_id", "part", "illegal", "head", "last", "cost", "rows", "kinds", "times", "entry", "leave", "tail")
    split = split.mapInArrow(_repaired, f"conv_id {kind}, part long, illegal long, head string, last string, cost long, audit string, rows array<struct<role: string, text: string>>")
    return held.where("whole").select(*columns), split


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its parts in order."""
    now, like, out = None, None, []

    def ended() -> None:
        if now is not None:
            out.append((now[0], now[1], now[2], "".join(now[4]), now[5].hexdigest()))

    for batch in batches:
        like = batch.column(0).type
        for conv, illegal, head, last, cost, audit, rows in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if now is None or now[0] != conv:
                ended()
                now = [conv, illegal, cost, last, [audit], hashlib.sha256(), False]
            else:
                now[1] += illegal + (now[3] + head not in ("su", "ua", "au"))
                now[3] = last
                now[4].append(audit)
            for row in rows:
                now[5].update(("\n" * now[6] + row["role"] + ":" + row["text"]).encode())
                now[6] = True
    ended()
    if out:
        conv, *columns = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(conv, like), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["conv_id", "illegal", "cost", "audit", "repaired_sha256"])


def digests(whole: DataFrame, split: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit and repaired_sha256 of ``repair``ed conversations."""
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    kind = whole.schema["conv_id"].dataType.simpleString()
    rest = split.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "illegal", "head", "last", "cost", "audit", "rows")
    rest = rest.mapInArrow(_streamed, f"conv_id {kind}, illegal long, cost long, audit string, repaired_sha256 string")
    return whole.select("conv_id", "illegal", "cost", "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256")).unionByName(rest)


def judged(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the conversations of ``counted`` rows."""
    held = materialize(with_faults(rows), "conversations-rows")
    first = F.when(F.col("seen"), F.col("n")).otherwise(F.col("n") - 1)
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    sums = held.groupBy(F.col("conv_id").alias("_id")).agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(first)).alias("duplicate"), F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    out = digests(*repair(held))
    return out.join(sums, out["conv_id"].eqNullSafe(sums["_id"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(conversations: DataFrame) -> DataFrame:
    """One row for each conversation of the table, damaged as the contract says and repaired."""
    tune(conversations.sparkSession)
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    found = judged(damaged(conversations))
    out = every.join(found, every["_id"].eqNullSafe(found["conv_id"]), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
