"""Cheapest repairs against all edit strings, and damaged conversations."""

import hashlib
import heapq
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import repair

SHAPE = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, step int, prices string"


def cheapest(rows):
    """(cost, audit, turns) by uniform-cost search over partial repairs;
    rows: (role, text, fault)."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, turns = heapq.heappop(heap)
        initials = "".join(r[:1] or "-" for r, _ in turns)
        if i == len(rows) and SHAPE.fullmatch(initials):
            return cost, audit, list(turns)
        # what follows depends on the rows read and on the last initial
        node = (i, initials[-1:])
        if node in seen:
            continue
        seen.add(node)
        more = [("I", 3, i, (*turns, (r, ""))) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            more.append(("D", 4, i + 1, turns))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                more.append(("K", extra, i + 1, (*turns, (role, text))))
                more += [("R", 3 + extra, i + 1, (*turns, (r, text))) for r in ("user", "assistant")]
        for edit, add, j, t in more:
            made = "".join(r[:1] or "-" for r, _ in t)
            if any(SHAPE.fullmatch(made + x) for x in ("", "a", "ua")):
                heapq.heappush(heap, (cost + add, audit + edit, j, t))


def faults_of(rows):
    """rows in order: (role, text) -> (role, text, fault)."""
    out, said = [], set()
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in said else "" if bare[-1] in ".!?" else "truncated"))
        said.add((role, text))
    return out


def summary(rows):
    """The report's columns after conv_id, of rows (turn, role, text) after
    damage."""
    rows = sorted(((t is not None, t or 0, r, x) for t, r, x in rows))
    marked = faults_of([(r, x) for _, _, r, x in rows])
    turns = [t for known, t, _, _ in rows if known]
    cost, audit, kept = cheapest(marked)
    count = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    body = "\n".join(f"{r}:{x}" for r, x in kept)
    return (gaps, *count, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest())


def damaged(rows):
    """(turn, role, text) of one conversation's rows (conv, turn, role, text)."""
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def auctioned(rows):
    """(cost, audit, turns) by the auction, layer by layer."""
    after = [repair.END]
    for role, _, fault in reversed(rows):
        after.append(repair.layer(repair._code(role), repair.FAULTS.index(fault), after[-1]))
    after.reverse()
    cost, audit, turns, state = after[0][0], "", [], 0
    for (role, text, fault), prices in zip(rows, after[1:]):
        for edit, _, state in repair.trace(repair._code(role), repair.FAULTS.index(fault), prices, state):
            audit += edit
            if edit != "D":
                turns.append((role if edit == "K" else repair.ROLE[state], "" if edit == "I" else text))
    for _ in repair.trace(None, 0, repair.END, state):
        audit += "I"
        turns.append((("user", "assistant")[len(turns) % 2 if not turns or turns[0][0][:1] != "s" else (len(turns) + 1) % 2], ""))
    return cost, audit, turns


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "u2"]), st.sampled_from(["Yes.", "no", "ok!", "cut off"]),
                          st.sampled_from(repair.FAULTS)), max_size=9))
def test_auction_finds_the_least_of_the_cheapest(rows):
    assert auctioned(rows) == cheapest(rows)


def test_prices_never_exceed_distances_and_no_arc_undercuts_them():
    for initial in "sua-":
        for fault in range(4):
            before = repair.layer(initial, fault, repair.END)
            for q in range(4):
                reach = [c + (repair.END if read else before)[to] for _, c, to, read in repair.arcs(q, initial, fault)]
                assert min(reach) == before[q]


def conversations():
    out = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}.") for i in range(40)]
    out += [(2, 0, "system", "Be brief"), (2, 1, "user", "Hi."), (2, 1, "user", "Hi."), (2, None, "assistant", "Early!"), (2, 9, None, None)]
    out += [(None, 3, "user", "No id?"), (None, None, "tool", "x" * 30_000 + "."), (3, 5, "assistant", " \t\n"), (3, 7, "user", "")]
    out += [(4, 0, "user", "Same."), (4, 1, "assistant", "Same."), (4, 2, "user", "Same."), (4, 3, "assistant", "Same.")] * 3
    out += [(5, None, None, None)] * 2 + [(i, j, ("user", "assistant", "system")[(i * j) % 3], f"{i} {j}" + ". "[j % 2]) for i in range(10, 60) for j in range(6)]
    return out + [(i, 0, "user", "Lone.") for i in range(100, 160)]


def test_damaged_conversations(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA).repartition(5)
    edits = repair.repair(repair.damage(df), "dropped")
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(edits).collect()}
    want = {c: summary(damaged([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert got == want
    assert (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want.values()
    assert all(max(t[k] for t in want.values()) for k in range(6))


def test_small_arrow_batches_and_undamaged_turns(spark):
    rows = conversations()
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        df = spark.createDataFrame([(*r, 0, "clash") for r in rows], SCHEMA)
        edits = repair.repair(df).collect()
    finally:
        spark.conf.set(key, before)
    for conv in {r[0] for r in rows}:
        own = sorted((e for e in edits if e.conv_id == conv), key=lambda e: e.step)
        lined = sorted(((t is not None, t or 0, r or " ", " " if x is None else x) for c, t, r, x in rows if c == conv))
        cost, audit, turns = cheapest(faults_of([(r, x) for _, _, r, x in lined]))
        assert (sum(e.cost for e in own), "".join(e.edit for e in own)) == (cost, audit)
        assert [(e.role, e.text) for e in own if e.edit != "D"] == turns


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.repair(repair.damage(df), "dropped")).collect() == []
