"""Conversation structure repair: the cheapest edits that make each conversation take turns.

A conversation's rows, ordered by turn (nulls first; ties by role, then text), are read by an automaton for ``(s?(ua)+)?`` over
the first letters of the roles. Edits: K keeps a row (0), R gives it the role that fits, user or assistant (3), D deletes it (4), I inserts
an empty turn of user or assistant (3). Blank rows and repeats of a role and text seen before must go; a truncated row that stays costs 3 more.

*Bidirectional tight arcs*: nodes are (rows read, state), arcs are edits. A pass from the end gives each node the least cost to the end,
a pass from the beginning the least cost so far; an arc is tight, that is on a cheapest way, when both and its own cost make the total.
A set of nodes, the frontier, then goes forward along tight arcs by the least letter that any of them offers, which spells the least of all cheapest edit lists.

Rows that are equal are one row with a count before anything is shuffled, and repeats cost one step whatever their number. A
conversation is sorted by Spark (which spills), first backwards, then forwards, and streams through both passes: a task
holds one batch and four costs, so that a conversation of any length needs no more memory. It is read by one task, since its hash is one
chain over all its texts.

Defined cases: a null role or text counts as one space, in the damage's key also a null conv_id or turn; null conv_id is a conversation; a
conversation without rows has zeros and empty texts; a role without letters fits nowhere; an empty table gives an empty result; extra
columns are ignored; texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

_BLANKS = " \t\n\x0b\x0c\r"
_FAR = 1 << 60

# fixed values: what edits cost
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3

#: State after a turn of user or assistant, by state: 0 nothing yet, 1 a system turn, 2 a user turn, 3 a whole exchange. The automaton allows one of both only.
_NEXT = (2, 2, 3, 2)
_SPEAKER = ("user", "user", "assistant", "user")
_FINAL = (0, 3)

EDITS = "conv_id bigint, turn bigint, role string, text string, n bigint, fault string, edit string, new_role string, cost bigint"
SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _kept(state: int, initial: str) -> int | None:
    """State after a kept row."""
    if initial == "s":
        return 1 if state == 0 else None
    return _NEXT[state] if initial == _SPEAKER[state][0] else None


def _arcs(state: int, initial: str, gone: bool, cut: bool) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of the edits of a row."""
    out = [("D", DELETE, state)]
    if not gone:
        kept, more = _kept(state, initial), CUT if cut else 0
        if kept is not None:
            out.append(("K", KEEP + more, kept))
        out.append(("R", REROLE + more, _NEXT[state]))
    return out


#: By (first letter, must go, truncated): the arcs of every state.
_TABLE = {(i, g, c): [_arcs(q, i, g, c) for q in range(4)] for i in ("s", "u", "a", "") for g in (False, True) for c in (False, True)}


def _with_inserts(cost: list[int]) -> list[int]:
    """Least costs to the end when turns may be inserted first."""
    a, b = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return [min(cost[0], INSERT + a), min(cost[1], INSERT + a), a, b]


def _after_inserts(cost: list[int]) -> list[int]:
    """Least costs so far when turns may have been inserted last."""
    user = min(cost[2], INSERT + min(cost[0], cost[1], cost[3]))
    return [cost[0], cost[1], user, min(cost[3], INSERT + user)]


_END = _with_inserts([0, _FAR, _FAR, 0])


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, n copies; n = 0: only the conversation exists) as one row for each (conv_id, turn, role, text), dealt by conv_id, with ``fault`` of the first copy."""
    one = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.expr("n = 0"), F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(_BLANKS))
    one = one.withColumn("k", F.row_number().over(seen)).withColumn("bare", F.length(bare) == 0).withColumn("end", F.right(bare, F.lit(1)))
    fault = F.when(F.col("n") == 0, None).when(F.col("bare"), "blank").when(F.col("k") > 1, "duplicate").when(~F.col("end").isin(".", "!", "?"), "truncated")
    return one.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


def _letters(batch: pa.RecordBatch) -> Iterator[tuple]:
    """conv_id, turn, role, first letter, n, fault of each row."""
    cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "n", "fault")]
    for conv, turn, role, n, fault in zip(*cols, strict=True):
        yield conv, turn, role, role[:1] if role[:1] in ("s", "u", "a") else "", n, fault


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from last to first: adds the least costs to the end, from before the row (b0 to b3) and from after its copies (a0 to a3)."""
    here, after = object(), list(_END)
    for batch in batches:
        out = np.empty((batch.num_rows, 8), np.int64)
        for k, (conv, _, _, initial, n, fault) in enumerate(_letters(batch)):
            if conv != here:
                here, after = conv, list(_END)
            out[k, 4:] = after
            if n:
                gone = fault in ("blank", "duplicate")
                rest = [x + DELETE * (n - 1) for x in after]
                after = _with_inserts([min(c + rest[to] for _, c, to in arcs) for arcs in _TABLE[initial, gone, fault == "truncated"]])
            out[k, :4] = after
        for j in range(8):
            batch = batch.append_column(f"{'ba'[j // 4]}{j % 4}", pa.array(out[:, j]))
        yield batch


class _Walk:
    """The frontier of one conversation: nodes at the place reached, costs so far, and the total."""

    def __init__(self, total: int):
        self.total, self.nodes = total, {0}
        self.so_far = _after_inserts([0, _FAR, _FAR, _FAR])

    def insert(self, ahead: list[int]) -> str:
        """Goes along tight inserts at this place; the role of the turn."""
        tight = [q for q in self.nodes if self.so_far[q] + INSERT + ahead[_NEXT[q]] == self.total]
        self.nodes = {_NEXT[q] for q in tight}
        return _SPEAKER[min(tight)]

    def step(self, arcs: list, before: list[int], after: list[int]) -> Iterator[tuple[str, str | None]]:
        """The edits at a row: (letter, new role), any inserts first."""
        while True:
            tight = [(letter, q, to) for q in self.nodes for letter, c, to in arcs[q] if self.so_far[q] + c + after[to] == self.total]
            tight += [("I", q, _NEXT[q]) for q in self.nodes if self.so_far[q] + INSERT + before[_NEXT[q]] == self.total]
            letter = min(tight)[0]
            if letter == "I":
                yield "I", self.insert(before)
                continue
            chosen = [(q, to) for x, q, to in tight if x == letter]
            self.nodes = {to for _, to in chosen}
            reached = [_FAR] * 4
            for q in range(4):
                for _, c, to in arcs[q]:
                    reached[to] = min(reached[to], self.so_far[q] + c)
            self.so_far = _after_inserts(reached)
            yield letter, _SPEAKER[chosen[0][0]] if letter == "R" else None
            return

    def end(self) -> Iterator[str]:
        """Roles of the turns inserted at the end."""
        while not any(q in _FINAL and self.so_far[q] == self.total for q in self.nodes):
            yield self.insert(_END)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows from first to last, with the costs to the end: one row for each edit, copies that go together in one."""
    here, walk = object(), None
    names = [f.split()[0] for f in EDITS.split(",")]

    def rows_of(edits: list[tuple], texts: pa.Array) -> pa.RecordBatch:
        at = pa.array([e[-1] for e in edits], pa.int64())
        cols = dict(zip(names, zip(*(e[:-1] for e in edits), strict=True), strict=True))
        kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "n": pa.int64(), "cost": pa.int64()}
        return pa.RecordBatch.from_arrays([texts.take(at) if c == "text" else pa.array(cols[c], kinds.get(c, pa.string())) for c in names], names)

    for batch in batches:
        edits: list[tuple] = []
        costs = np.column_stack([np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("b0", "b1", "b2", "b3", "a0", "a1", "a2", "a3")]).tolist()
        for k, (conv, turn, role, initial, n, fault) in enumerate(_letters(batch)):
            if conv != here:
                if walk:
                    edits += [(here, None, None, None, 0, None, "I", r, walk.total, None) for r in walk.end()]
                here, walk = conv, _Walk(costs[k][0])
            if not n:
                edits.append((conv, None, None, None, 0, None, None, None, walk.total, None))
                continue
            before, after = costs[k][:4], [x + DELETE * (n - 1) for x in costs[k][4:]]
            gone = fault in ("blank", "duplicate")
            for letter, new in walk.step(_TABLE[initial, gone, fault == "truncated"], before, after):
                edits.append((conv, None, None, None, 0, None, "I", new, walk.total, None) if letter == "I" else (conv, turn, role, None, 1, fault, letter, new, walk.total, k))
            if n > 1:
                walk.so_far = [x + DELETE * (n - 1) for x in walk.so_far]
                edits.append((conv, turn, role, None, n - 1, "blank" if fault == "blank" else "duplicate", "D", None, walk.total, k))
        if edits:
            yield rows_of(edits, batch.column(batch.schema.get_field_index("text")))
    if walk:
        edits = [(here, None, None, None, 0, None, "I", r, walk.total, None) for r in walk.end()]
        if edits:
            yield rows_of(edits, pa.array([], pa.string()))


def repair(rows: DataFrame) -> DataFrame:
    """The edits of all conversations in ``rows`` (conv_id, turn, role, text, n): one row each, in order within a task's rows.

    edit K, R, D or I (null: the conversation has no row here), turn, role and text of the row (null for inserts), n copies, fault,
    new_role for R and I, cost of the whole conversation. The repaired conversation is its rows with K, R and I."""
    marked = faults(rows)
    schema = ", ".join(f"{c} {t}" for c, t in marked.dtypes) + "".join(f", {s}{q} bigint" for s in "ba" for q in range(4))
    back = marked.sortWithinPartitions(F.col("conv_id"), F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text")).mapInArrow(_backward, schema)
    return back.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(_forward, EDITS)


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.hash, self.parts, self.audit = conv, hashlib.sha256(), 0, []
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.initial: str | None = None

    def add(self, turn, role, text, n, fault, edit, new_role, cost) -> None:
        self.cost = cost
        if n:
            if turn is not None:
                self.turns += turn != self.turn or self.high is None
                self.low = turn if self.low is None else self.low
                self.high = self.turn = turn
            if fault:
                setattr(self, fault, getattr(self, fault) + n)
            self.illegal += n - 1 + (self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"))
            self.initial = role[:1]
        if edit:
            self.audit.append(edit * max(n, 1))
            if edit != "D":
                line = f"{role if edit == 'K' else new_role}:{'' if edit == 'I' else text}"
                self.hash.update((("\n" if self.parts else "") + line).encode())
                self.parts += 1

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def summaries(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``edits``, straight from ``repair``: no shuffle may stand between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SUMMARY.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in SUMMARY.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        now: _Digest | None = None
        for batch in batches:
            done = []
            for conv, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(*rest)
            if done:
                yield made(done)
        if now:
            yield made([now.row()])

    return edits.mapInArrow(run, SUMMARY)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows damaged by crc32 of ``conv_id:turn``, n copies each; a dropped row leaves n = 0, without its values."""
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")
    shown = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn))) % 20
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(shown(F.col("role")))
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(shown(F.col("text")), ".!?", "")).otherwise(shown(F.col("text")))
    n = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint")
    return conversations.select(conv.alias("conv_id"), F.when(kind != 0, turn).alias("turn"), role.alias("role"), text.alias("text"), n.alias("n"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries(repair(damaged(table(spark, sf_dir, "conversations"))))


def _arc(letter: str, cost: str, state: int, line: str | None) -> str:
    rest = f"nx[{state + 1}]"
    return f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'b': {rest + '.b' if line is None else f'list_prepend({line}, {rest}.b)'}}}"


def _sql() -> str:
    """DuckDB SQL: rows one by one from the last, with the least (cost, letters) to the end from every state."""
    more = f"CASE WHEN fault = 'truncated' THEN {CUT} ELSE 0 END"
    rows, far = [], "{'c': 1000000000000, 'a': '', 'b': []::varchar[]}"
    for q in range(4):
        kept = " ".join(f"WHEN initial = '{i}' THEN {_arc('K', more, _kept(q, i), "role || ':' || text")}" for i in ("s", "u", "a") if _kept(q, i) is not None)
        stays = f"list_min([{_arc('D', str(DELETE), q, None)}, {_arc('R', f'{REROLE} + {more}', _NEXT[q], f"'{_SPEAKER[q]}:' || text")}, CASE {kept} ELSE {far} END])"
        rows.append(f"CASE WHEN fault IN ('blank', 'duplicate') THEN {_arc('D', str(DELETE), q, None)} ELSE {stays} END")
    inserted = lambda x, q: f"{{'c': {x}.c + {INSERT}, 'a': 'I' || {x}.a, 'b': list_prepend('{_SPEAKER[q]}:', {x}.b)}}"
    closed = "[least(y[1], {0}), least(y[2], {1}), z[1], z[2]]".format(inserted("z[1]", 0), inserted("z[1]", 1))
    pair = "[least(y[3], {0}), least(y[4], {1})]".format(inserted("y[4]", 2), inserted("y[3]", 3))
    close = lambda base, source: f"(SELECT {closed} FROM (SELECT y, {pair} AS z FROM (SELECT {base} AS y {source})))"
    nothing = "{'c': 0::bigint, 'a': '', 'b': []::varchar[]}"
    return rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS key FROM conversations),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(key)), lambda i: ascii(substr(key, i + 1, 1))::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM keyed, tab),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw),
num AS (SELECT *, row_number() OVER w AS k, left(role, 1) AS initial FROM dam WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
rws AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault,
  lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM num),
per AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM rws GROUP BY conv_id),
best AS (SELECT conv_id, n + 1 AS k, {close(f"[{nothing}, {far}, {far}, {nothing}]", "")} AS nx FROM per
  UNION ALL SELECT best.conv_id, r.k, {close("[" + ", ".join(rows) + "]", "")} AS nx FROM best JOIN rws r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.k = best.k - 1)
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(nx[1].c, 0)::bigint AS cost, coalesce(nx[1].a, '') AS audit, sha256(coalesce(array_to_string(nx[1].b, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.k = 1 AND best.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE = _sql()
