"""Structure repair of conversations by an auction shortest-path algorithm.

A conversation's rows span a lattice of nodes (rows read, state), the states
being: nothing written, a system turn, a user turn, an assistant turn. Arcs
are edits with whole costs: Keep, Rerole, Delete lead to the next row, Insert
stays at the row. The structure asked for is ``(s?(ua)+)?`` by role initials.

Every node has a price that never exceeds its shortest distance to the end
(complementary slackness: no price is above an arc's cost plus the price at
its head). From an origin the auction holds a path and looks at the best arc
out of the path's last node: if cost plus price there is above the node's
own price, the price rises to it and the path is contracted by that node; if
not, the path is extended along the arc, until it reaches a node whose price
has converged. Each node is an origin in turn, the last row's first, so prices
are kept from one auction to the next and every path is short. A converged
price is the distance, so exactly the tight arcs (cost plus price at the head
equals the price at the tail) lie on cheapest repairs, and following the tight
arc with the least initial gives the least of the cheapest edit strings.

Rows stream through a task twice: backwards, where the auction needs only the
prices after the present row, and forwards, where the edits are traced with the
prices that came with the rows. Neither holds a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_SPACE = " \t\n\x0b\x0c\r"
#: States: nothing, system, user, assistant. The turn that each accepts by
#: inserting or reroling, and the states from which a conversation may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_DONE = (NOTHING, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAULTS = ("", "blank", "duplicate", "truncated")
#: Layers that a task keeps converged: prices differ little, so few recur.
CACHED = 1 << 16


def _kept(state: int, initial: str) -> int | None:
    """State after keeping a turn with this initial, None if not allowed."""
    if initial == "s" and state == NOTHING:
        return SYSTEM
    if initial == "u" and _NEXT[state] == USER:
        return USER
    return ASSISTANT if initial == "a" and state == USER else None


def arcs(state: int, initial: str, fault: int) -> tuple[tuple[str, int, int, bool], ...]:
    """(edit, cost, state at the head, whether the row is read) of the arcs at
    a row with this initial (one of s, u, a, -) and fault, least edit first."""
    out = [("D", DELETE, state, True), ("I", INSERT, _NEXT[state], False)]
    if fault in (0, 3):
        more = TRUNCATED if fault == 3 else 0
        to = _kept(state, initial)
        if to is not None:
            out.append(("K", KEEP + more, to, True))
        out.append(("R", REROLE + more, _NEXT[state], True))
    return tuple(sorted(out))


def auction(origin: int, out: dict, price: dict, converged: set) -> None:
    """Raise ``price`` until that of ``origin`` is its distance to the nodes
    in ``converged``. ``out[node]`` lists (cost, head)."""
    path = [origin]
    while path[-1] not in converged:
        node = path[-1]
        best, head = min((cost + price[to], to) for cost, to in out[node])
        if price[node] < best:
            price[node] = best
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)
    converged.update(path)


#: Nodes of one layer: the states before a row as 0-3, after it as 4-7.
def layer(initial: str, fault: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Converged prices before a row, from those after it."""
    out = {q: [(cost, to + 4 * read) for _, cost, to, read in arcs(q, initial, fault)] for q in range(4)}
    price = {q + 4: p for q, p in enumerate(after)} | {q: min(after) for q in range(4)}
    converged = {4, 5, 6, 7}
    for q in range(4):
        auction(q, out, price, converged)
    return tuple(price[q] for q in range(4))


def _end() -> tuple[int, ...]:
    """Converged prices after the last row; the end is node 4."""
    out = {q: [(INSERT, _NEXT[q])] + [(0, 4)] * (q in _DONE) for q in range(4)}
    price, converged = dict.fromkeys(range(5), 0), {4}
    for q in range(4):
        auction(q, out, price, converged)
    return tuple(price[q] for q in range(4))


END = _end()


def trace(initial: str | None, fault: int, after: tuple[int, ...], state: int) -> tuple[tuple[str, int, int], ...]:
    """(edit, cost, state) along the tight arcs with the least initials, from
    ``state`` before a row until the row is read; without a row
    (``initial`` None) until the conversation may end."""
    before = END if initial is None else layer(initial, fault, after)
    moves = []
    while True:
        if initial is None:
            if state in _DONE:
                return tuple(moves)
            edit, cost, state, read = "I", INSERT, _NEXT[state], False
        else:
            edit, cost, state, read = next(
                x for x in arcs(state, initial, fault) if x[1] + (after if x[3] else before)[x[2]] == before[state])
        moves.append((edit, cost, state))
        if read:
            return tuple(moves)


def _code(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "-"


PRICED = "conv_id bigint, turn bigint, role string, text string, dropped boolean, fault int, rows_left bigint, prices int"
_KEY = ("conv_id", "turn", "role", "digest", "dropped")


def _price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backwards over rows: each row's fault, the rows after it, and the
    prices after it (less the least of them, a byte each)."""
    conv, after, left = object(), END, 0
    known = lru_cache(maxsize=CACHED)(layer)

    def priced(rows: pa.Table, before: tuple | None) -> pa.RecordBatch:
        nonlocal conv, after, left
        column = {c: rows.column(c).to_pylist() for c in (*_KEY, "mark", "again")}
        keys = [*zip(*(column[c] for c in _KEY)), before]
        faults, lefts, prices = [], [], []
        for i, (own, turn, role, digest, gone) in enumerate(keys[:-1]):
            if own != conv:
                conv, after, left = own, END, 0
            mark = column["mark"][i]
            # an equal row of the same turn stands right before this one
            fault = 2 if mark != 1 and (column["again"][i] or keys[i] == keys[i + 1]) else mark
            faults.append(fault)
            lefts.append(left)
            prices.append(int.from_bytes(bytes(after), "big"))
            if not gone:
                now = known(_code(role), fault, after)
                after, left = tuple(p - min(now) for p in now), left + 1
        names = [x.split()[0] for x in PRICED.split(", ")]
        made = {"fault": pa.array(faults, pa.int32()), "rows_left": pa.array(lefts, pa.int64()), "prices": pa.array(prices, pa.int32())}
        return pa.Table.from_arrays([made[n] if n in made else rows.column(n) for n in names], names).combine_chunks().to_batches()[0]

    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        now = pa.Table.from_batches([b])
        now = now if held is None else pa.concat_tables([held, now])
        rest, held = now.slice(0, now.num_rows - 1), now.slice(now.num_rows - 1)
        if rest.num_rows:
            last = held.select(list(_KEY)).to_pylist()[0]
            yield priced(rest, tuple(last[c] for c in _KEY))
    if held is not None:
        yield priced(held, None)


EDITS = ("conv_id bigint, step bigint, edit string, cost bigint, fault string, turn bigint, from_role string, "
         "role string, text string")
_TYPES = {"bigint": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forwards over priced rows: the edits, in order."""
    now: list | None = None  # conversation, edits so far, state
    known = lru_cache(maxsize=CACHED)(trace)

    def inserted(cost, state):
        now[1] += 1
        return now[0], now[1] - 1, "I", cost, None, None, None, ROLE[state], ""

    def ended():
        rows = [inserted(cost, state) for _, cost, state in known(None, 0, END, now[2])]
        if not now[1]:
            rows.append((now[0], 0, None, 0, None, None, None, None, None))
        return rows

    for b in batches:
        rows = []
        for conv, turn, role, text, gone, fault, prices in zip(*(b.column(c).to_pylist() for c in (
                "conv_id", "turn", "role", "text", "dropped", "fault", "prices"))):
            if now is None or now[0] != conv:
                if now is not None:
                    rows += ended()
                now = [conv, 0, NOTHING]
            if gone:
                continue
            for edit, cost, state in known(_code(role), fault, tuple(prices.to_bytes(4, "big")), now[2]):
                if edit == "I":
                    rows.append(inserted(cost, state))
                else:
                    new = {"K": role, "R": ROLE.get(state), "D": None}[edit]
                    rows.append((conv, now[1], edit, cost, FAULTS[fault], turn, role, new, None if edit == "D" else text))
                    now[1] += 1
                now[2] = state
        if rows:
            yield _batch(rows, EDITS)
    if now is not None and (rows := ended()):
        yield _batch(rows, EDITS)


def repair(turns: DataFrame, dropped: str | None = None) -> DataFrame:
    """The edits of the cheapest repair of each conversation of
    ``turns(conv_id, turn, role, text)``, in order: edit (K, R, D or I), cost,
    the row's fault (blank, duplicate, truncated or empty), turn and role, and
    the repaired role and text (NULL for D).

    Rows go by turn, NULL first, then role and text; NULL roles and texts are
    one space, and an empty role has no initial, so its turn can not be kept.
    Rows with a NULL conv_id are one conversation; equal rows of a
    turn are duplicates of the first of them. Rows where the column
    ``dropped`` is true are passed over; a conversation with no others gives
    one row with a NULL edit. A table without rows gives none."""
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    bare = F.rtrim("text", F.lit(_SPACE))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), gone.alias("dropped"))
    rows = rows.withColumn("mark", F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(3))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("at"))
    # only texts that a conversation says again meet the rows, one row each
    said = (rows.where(~F.col("dropped")).groupBy("conv_id", "role", "digest")
            .agg(F.min(when).alias("first"), F.max(when).alias("_last")).where(F.col("first") < F.col("_last"))
            .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first"))
    rows = rows.join(said, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role"))
                     & (F.col("digest") == F.col("_digest")), "left")
    rows = rows.select("conv_id", "turn", "role", "text", "digest", "dropped", "mark", F.coalesce(F.col("first") < when, F.lit(False)).alias("again"))
    back = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("turn"), F.desc("role"), F.desc("text"))
    priced = back.mapInArrow(_price, PRICED).sortWithinPartitions("conv_id", F.desc("rows_left"))
    return priced.mapInArrow(_edit, EDITS)


REPORT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
          "audit string, repaired_sha256 string")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: dict | None = None

    def row():
        gaps = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
        return (now["conv"], gaps, *(now[f] for f in FAULTS[1:]), now["illegal"], now["cost"], "".join(now["audit"]), now["sha"].hexdigest())

    for b in batches:
        rows = []
        for conv, _, edit, cost, fault, turn, old, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if now is None or now["conv"] != conv:
                if now is not None:
                    rows.append(row())
                now = {"conv": conv, "turns": 0, "first": None, "last": None, "illegal": 0, "cost": 0, "audit": [], "sha": sha256(),
                       "began": False, "before": None, **dict.fromkeys(FAULTS, 0)}
            if edit is None:
                continue
            now["cost"] += cost
            now["audit"].append(edit)
            if edit != "I":
                now[fault] += 1
                if now["before"] is not None and now["before"] + old[:1] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["before"] = old[:1]
                if turn is not None and turn != now["last"]:
                    now["turns"] += 1
                    now["first"] = turn if now["first"] is None else now["first"]
                    now["last"] = turn
            if edit != "D":
                now["sha"].update(("\n" * now["began"] + f"{role}:{text}").encode())
                now["began"] = True
        if rows:
            yield _batch(rows, REPORT)
    if now is not None:
        yield _batch([row()], REPORT)


def report(edits: DataFrame) -> DataFrame:
    """Per conversation, from ``repair``'s output alone (in its order): turns
    missing between the least and the greatest, rows by fault, illegal
    neighbours, cost, the edits' initials and the digest of the repaired
    turns."""
    return edits.mapInArrow(_report, REPORT)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` damaged by crc32 of ``conv_id:turn`` (NULLs are one space)
    modulo 20: 0 marks the row as ``dropped``, 1 empties its text, 2 takes out
    its stops, 3 repeats it, 4 sets its role to user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return (turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (F.col("kind") == 0).alias("dropped"),
                    F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy"))


ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
crcs AS (
  SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1),
      lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) for i in range(8)]), lambda x, z:
      xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM crcs WHERE kind <> 0),
convs AS (SELECT row_number() OVER () AS c, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
lined AS (
  SELECT c, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i
  FROM damaged d JOIN convs v ON v.conv_id IS NOT DISTINCT FROM d.conv_id),
marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair FROM lined),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY c),
inserts(q, more, t, letters, turns) AS (
  VALUES (0, 0, 0, '', CAST([] AS VARCHAR[])), (1, 0, 1, '', []), (2, 0, 2, '', []), (3, 0, 3, '', []),
    (0, 3, 2, 'I', ['user:']), (1, 3, 2, 'I', ['user:']), (3, 3, 2, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
    (0, 6, 3, 'II', ['user:', 'assistant:']), (1, 6, 3, 'II', ['user:', 'assistant:']),
    (3, 6, 3, 'II', ['user:', 'assistant:']), (2, 6, 2, 'II', ['assistant:', 'user:'])),
edits(q, edit, initial, t) AS (
  VALUES (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (3, 'K', 'u', 2), (2, 'K', 'a', 3),
    (0, 'R', NULL, 2), (1, 'R', NULL, 2), (3, 'R', NULL, 2), (2, 'R', NULL, 3),
    (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3)),
walk AS (
  SELECT v.c, CAST(0 AS BIGINT) AS i, s.t AS q, CAST(s.more AS BIGINT) AS cost, s.letters AS audit, s.turns AS turns
  FROM convs v JOIN inserts s ON s.q = 0
  UNION ALL
  SELECT w.c, w.i + 1, s.t,
    min(w.cost + s.more + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
      + CASE WHEN m.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END),
    arg_min(w.audit || e.edit || s.letters, (w.cost + s.more + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
      + CASE WHEN m.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END, w.audit || e.edit || s.letters)),
    arg_min(list_concat(w.turns, CASE e.edit WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [m.role || ':' || m.text]
        ELSE [CASE e.t WHEN 2 THEN 'user:' ELSE 'assistant:' END || m.text] END, s.turns),
      (w.cost + s.more + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
        + CASE WHEN m.fault = 'truncated' AND e.edit <> 'D' THEN 3 ELSE 0 END, w.audit || e.edit || s.letters))
  FROM walk w JOIN marked m ON m.c = w.c AND m.i = w.i + 1
  JOIN edits e ON e.q = w.q AND (e.initial IS NULL OR e.initial = m.initial) AND (e.edit = 'D' OR m.fault NOT IN ('blank', 'duplicate'))
  JOIN inserts s ON s.q = e.t
  GROUP BY w.c, w.i, s.t),
best AS (
  SELECT w.c, min(w.cost) AS cost, arg_min(w.audit, (w.cost, w.audit)) AS audit, arg_min(w.turns, (w.cost, w.audit)) AS turns
  FROM walk w JOIN counts k ON k.c = w.c AND w.i = k.n WHERE w.q IN (0, 3) GROUP BY w.c)
SELECT v.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate,
  coalesce(k.truncated, 0) AS truncated, coalesce(k.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.turns, chr(10)), '')) AS repaired_sha256
FROM convs v LEFT JOIN counts k ON k.c = v.c LEFT JOIN best b ON b.c = v.c
"""
