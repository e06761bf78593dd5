"""Repair of conversations whose turns are out of order, by depth-first branch and bound (operator 13).

A repaired conversation is empty, or an optional system turn followed by (user, assistant) pairs. A row is
kept (K, free), given another role (R, 2), deleted (D, 3; blank and repeated rows must be) or a turn of empty
text is inserted (I, 2); a truncated row that stays adds 1. The cheapest edits win, ties go to the audit (their
letters in order) that is least in ASCII.

A search node is (rows read, state), state being what the last turn kept was. Its prefixes are dropped where
the node's dominance table holds a cheaper one, or one as cheap and lower in ASCII: as many rows are read and
as much is paid, neither audit is the start of the other, so the order of the two holds for any common end.
They are dropped as well where their cost and the suffix bound exceed the incumbent, or reach it and their audit
is above the incumbent's. The bound is what the rest costs at least if audits do not matter, taken backwards over
rows and states, so that the search only opens prefixes that can tie. (A bound by counts of illegal neighbours
is looser: at a thousand rows of random roles the search did not end within minutes.)

Rows are dealt by conversation and span of turns, sorted there and read as a stream. A conversation inside one
span is solved at once. One with several, or with more rows than `SPAN`, is solved piece by piece for all pairs
of states before and after it; a row per piece then meets the others of its conversation to find the cheapest
chain. Its text goes through one task in order, unbuffered, since its digest is one hash of all of it.

Null roles and texts are one space, null turns come first, a null conversation id is a conversation of its own.
Rows of one turn are taken by role and text, in bytes. A conversation that lost all its rows, or a repaired one
without turns, has the digest of the empty string. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stage

#: Turns of a span, and rows of a piece of a long conversation at most.
SPAN = 1024
RETYPE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing kept yet, after a system, user, assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
_LAST = ["", "s", "u", "a"]
_LEGAL = {"su", "ua", "au"}
#: State after keeping a row of this initial, by state before.
_AFTER = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER}]
_NEXT = [USER, USER, ASSISTANT, USER]
_WHITE = " \t\n\r\x0b\x0c"

Row = tuple[str, bool, bool]  # initial of its role, must be deleted, truncated


def _bounds(rows: list[Row], ends: tuple[int, ...]) -> list[list[float]]:
    """The least that the rows from each one on cost, by state before it, whatever their audit."""
    cost = [0 if s in ends else math.inf for s in range(4)]

    def with_inserts(cost: list[float]) -> list[float]:
        for _ in range(2):  # no more than two turns are ever inserted at one place
            cost = [min(c, INSERT + cost[_NEXT[s]]) for s, c in enumerate(cost)]
        return cost

    out = [with_inserts(cost)]
    for initial, forced, cut in reversed(rows):
        later, cost = out[-1], []
        for s in range(4):
            least = DELETE + later[s]
            if not forced:
                kept = _AFTER[s].get(initial)
                stay = min(RETYPE + later[_NEXT[s]], math.inf if kept is None else later[kept])
                least = min(least, stay + cut * TRUNCATED)
            cost.append(least)
        out.append(with_inserts(cost))
    return out[::-1]


def solve(rows: list[Row], start: int = START, ends: tuple[int, ...] = (START, ASSISTANT)) -> tuple[int, str] | None:
    """(cost, audit) of the best edits that lead from state `start` to one of `ends`; None if there are none."""
    n = len(rows)
    bounds = _bounds(rows, ends)
    if bounds[0][start] == math.inf:
        return None

    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {(0, start): (0, "")}
    stack = [(0, start, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i, state] != (cost, audit):
            continue  # a better prefix has come meanwhile
        if i == n and state in ends and (best is None or (cost, audit) < best):
            best = (cost, audit)
        follow = _NEXT[state]
        moves = [(cost + INSERT, "I", i, follow)]
        if i < n:
            initial, forced, cut = rows[i]
            moves.append((cost + DELETE, "D", i + 1, state))
            if not forced:
                kept = _AFTER[state].get(initial)
                if kept is not None:
                    moves.append((cost + cut * TRUNCATED, "K", i + 1, kept))
                if kept != follow:
                    moves.append((cost + RETYPE + cut * TRUNCATED, "R", i + 1, follow))
        open_moves = []
        for paid_so_far, letter, j, to in moves:
            least, longer = paid_so_far + bounds[j][to], audit + letter
            if least == math.inf or best is not None and (least > best[0] or least == best[0] and longer > best[1][: len(longer)]):
                continue
            known = table.get((j, to))
            if known is not None and known <= (paid_so_far, longer):
                continue
            table[j, to] = (paid_so_far, longer)
            open_moves.append((least, letter, j, to, paid_so_far, longer))
        open_moves.sort(reverse=True)
        stack.extend((j, to, paid_so_far, longer) for _, _, j, to, paid_so_far, longer in open_moves)
    return best


def chain(pieces: list[dict[tuple[int, int], tuple[int, str]]], ends: tuple[int, ...] = (START, ASSISTANT)) -> list[tuple[int, int, str]]:
    """State before, cost and audit of each piece in the cheapest chain; `pieces` hold the best by (state before, after)."""
    best: dict[int, tuple[int, str, tuple]] = {START: (0, "", ())}
    for ways in pieces:
        after: dict[int, tuple[int, str, tuple]] = {}
        for (a, b), (cost, audit) in ways.items():
            if a in best:
                found = (best[a][0] + cost, best[a][1] + audit, (best[a][2], a, cost, audit))
                if b not in after or found[:2] < after[b][:2]:
                    after[b] = found
        best = after
    _, _, link = min((best[e] for e in ends if e in best), key=lambda x: x[:2])
    out = []
    while link:
        link, a, cost, audit = link
        out.append((a, cost, audit))
    return out[::-1]


class Writer:
    """Applies an audit to the rows of a conversation as they come."""

    def __init__(self, emit: Callable[[str], None]):
        self.emit, self.state, self.audit, self.at = emit, START, "", 0

    def _turn(self, role: str, text: str, state: int) -> None:
        self.emit(f"{role}:{text}")
        self.state = state

    def _inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._turn("assistant" if self.state == USER else "user", "", _NEXT[self.state])
            self.at += 1

    def edits(self, audit: str) -> None:
        """The edits of the next rows, and of all that is inserted before the first of them."""
        self.audit, self.at = audit, 0
        self._inserts()

    def row(self, role: str, text: str) -> None:
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self._turn(role, text, _AFTER[self.state][role[:1]])
        elif letter == "R":
            self._turn("assistant" if self.state == USER else "user", text, _NEXT[self.state])
        self._inserts()


class _Digest:
    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def __call__(self, line: str) -> None:
        self.hash.update(("\n" if self.some else "").encode() + line.encode())
        self.some = True


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_c, _turn, _role, _text after the faults that each row's crc32 of `conv_id:turn` picks."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat(plain(conv_id), F.lit(":"), plain(turn))) % 20
    rows = turns.select(F.col(conv_id).alias("_c"), F.col(turn).cast("long").alias("_turn"), plain(role).alias("_role"), plain(text).alias("_text"), pick.alias("_pick"))
    emptied = F.when(F.col("_pick") == 1, F.lit("")).when(F.col("_pick") == 2, F.translate("_text", ".!?", "")).otherwise(F.col("_text"))
    copies = F.explode(F.when(F.col("_pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where(F.col("_pick") != 0).select(
        "_c", "_turn", F.when(F.col("_pick") == 4, F.lit("user")).otherwise(F.col("_role")).alias("_role"), emptied.alias("_text"), copies.alias("_copy")
    ).drop("_copy")


def _place(value: Column) -> Column:
    """Orders nulls first, also inside min and max."""
    return F.struct(value.isNotNull().alias("some"), value.alias("at"))


_PIECE = pa.schema(
    [
        ("_chunk", pa.int64()), ("_sub", pa.int32()), ("_many", pa.bool_()), ("_rows", pa.int64()), ("_turns", pa.int64()), ("_low", pa.int64()), ("_high", pa.int64()), ("_head", pa.string()),
        ("_tail", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
        ("_ways", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))), ("_sha", pa.string()),
    ]
)
_PIECE_SQL = (
    "_c {}, _chunk bigint, _sub int, _many boolean, _rows bigint, _turns bigint, _low bigint, _high bigint, _head string, _tail string, "
    "blank bigint, duplicate bigint, truncated bigint, illegal bigint, _ways array<struct<a int, b int, cost bigint, audit string>>, _sha string"
)


class _Piece:
    """Rows of one span of a conversation, or of a part of it."""

    def __init__(self, conv, chunk, many: bool, sub: int):
        self.conv, self.chunk, self.many, self.sub = conv, chunk, many, sub
        self.rows: list[Row] = []
        self.texts: list[tuple[str, str]] = []
        self.faults = [0, 0, 0]
        self.turns, self.low, self.high, self.illegal = 0, None, None, 0

    def add(self, role: str, text: str, turn, new_turn: bool, repeated: bool) -> None:
        bare = text.strip(_WHITE)
        fault = 0 if not bare else 1 if repeated else 2 if bare[-1] not in ".!?" else None
        if fault is not None:
            self.faults[fault] += 1
        if new_turn and turn is not None:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        if self.rows and self.rows[-1][0] + role[:1] not in _LEGAL:
            self.illegal += 1
        self.rows.append((role[:1], fault in (0, 1), fault == 2))
        if not self.many:
            self.texts.append((role, text))

    def result(self) -> dict:
        ways, sha = [], None
        if self.many:
            for a in range(4):
                for b in range(4):
                    found = solve(self.rows, a, (b,))
                    if found is not None:
                        ways.append({"a": a, "b": b, "cost": found[0], "audit": found[1]})
        else:
            cost, audit = solve(self.rows)
            ways, digest = [{"a": START, "b": ASSISTANT, "cost": cost, "audit": audit}], _Digest()
            writer = Writer(digest)
            writer.edits(audit)
            for role, text in self.texts:
                writer.row(role, text)
            sha = digest.hash.hexdigest()
        return {
            "_c": self.conv, "_chunk": self.chunk, "_sub": self.sub, "_many": self.many, "_rows": len(self.rows), "_turns": self.turns, "_low": self.low, "_high": self.high,
            "_head": self.rows[0][0], "_tail": self.rows[-1][0], "blank": self.faults[0], "duplicate": self.faults[1], "truncated": self.faults[2], "illegal": self.illegal, "_ways": ways, "_sha": sha,
        }


def _read(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in columns])


def _pieces(kind: pa.DataType, span: int):
    """Sorted rows to `_PIECE` rows."""
    schema = pa.schema([("_c", kind), *_PIECE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, before, out = None, None, []
        for conv, chunk, turn, role, text, many, first in _read(batches, ["_c", "_chunk", "_turn", "_role", "_text", "_many", "_first"]):
            if piece is None or (conv, chunk) != (piece.conv, piece.chunk):
                if piece is not None:
                    out.append(piece.result())
                piece, before = _Piece(conv, chunk, many, 0), None
            elif many and len(piece.rows) >= span:
                out.append(piece.result())
                piece = _Piece(conv, chunk, many, piece.sub + 1)
            # `first` is the place of the first of several rows of this role and text.
            repeated = first is not None and ((first["some"], first["at"]) != (turn is not None, turn) or before == (turn, role, text))
            piece.add(role, text, turn, before is None or before[0] != turn, repeated)
            before = (turn, role, text)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if piece is not None:
            out.append(piece.result())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


_TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _chained(kind: pa.DataType):
    """Pieces of a long conversation to their audits; the first one's row has its totals."""
    schema = pa.schema([("_c", kind), ("_chunk", pa.int64()), ("_sub", pa.int32()), ("_part", pa.string()), *[(c, pa.int64()) for c in _TOTALS], ("audit", pa.string())])

    def run(key: tuple, t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["_chunk"] is not None, r["_chunk"] or 0, r["_sub"]))
        found = chain([{(w["a"], w["b"]): (w["cost"], w["audit"]) for w in r["_ways"]} for r in rows])
        seen = [r for r in rows if r["_low"] is not None]
        total = {c: sum(r[c] for r in rows) for c in _TOTALS[1:5]}
        total["illegal"] += sum(a["_tail"] + b["_head"] not in _LEGAL for a, b in zip(rows, rows[1:]))
        total["gaps"] = seen[-1]["_high"] - seen[0]["_low"] + 1 - sum(r["_turns"] for r in rows) if seen else 0
        total |= {"cost": sum(c for _, c, _ in found), "audit": "".join(a for _, _, a in found)}
        out = [{"_c": r["_c"], "_chunk": r["_chunk"], "_sub": r["_sub"], "_part": audit} for r, (_, _, audit) in zip(rows, found)]
        out[0] |= total
        return pa.Table.from_pylist(out, schema)

    return run


def _digests(kind: pa.DataType):
    """Audits of pieces, each before its rows, to (_c, _sha)."""
    schema = pa.schema([("_c", kind), ("_sha", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, writer, digest, queue = None, None, None, []
        for c, part, role, text in _read(batches, ["_c", "_part", "_role", "_text"]):
            if writer is None or c != conv:
                if writer is not None:
                    yield pa.RecordBatch.from_pylist([{"_c": conv, "_sha": digest.hash.hexdigest()}], schema)
                conv, digest, queue = c, _Digest(), []
                writer = Writer(digest)
            if part is not None:
                queue.append(part)
                continue
            if queue:
                writer.edits("".join(queue))
                queue = []
            writer.row(role, text)
        if writer is not None:
            yield pa.RecordBatch.from_pylist([{"_c": conv, "_sha": digest.hash.hexdigest()}], schema)

    return run


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", span: int = SPAN) -> DataFrame:
    """Every conversation of `turns`, damaged by `damage` and repaired: `conv_id`, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(turns.schema[conv_id].dataType)
    name = turns.schema[conv_id].dataType.simpleString()
    key = F.md5(F.concat(F.length("_role").cast("string"), F.lit(":"), F.col("_role"), F.col("_text")))
    rows = damage(turns, conv_id, turn, role, text).withColumns({"_chunk": F.floor(F.col("_turn") / span), "_key": F.unhex(key)})

    again = rows.groupBy(F.col("_c").alias("_rc"), F.col("_key").alias("_rk")).agg(F.count(F.lit(1)).alias("n"), F.min(_place(F.col("_turn"))).alias("_first"))
    again = stage(again.where(F.col("n") > 1).drop("n"), "repeated-turns")
    wide = rows.groupBy(F.col("_c").alias("_wc")).agg(F.count(F.lit(1)).alias("n"), F.min(_place(F.col("_chunk"))).alias("lo"), F.max(_place(F.col("_chunk"))).alias("hi"))
    wide = stage(wide.where((F.col("n") > span) | (F.col("lo") != F.col("hi"))).select("_wc", F.lit(True).alias("_long")), "long-conversations")

    known = rows.join(again, F.col("_c").eqNullSafe(F.col("_rc")) & (F.col("_key") == F.col("_rk")), "left").join(wide, F.col("_c").eqNullSafe(F.col("_wc")), "left")
    known = known.select("_c", "_chunk", "_turn", "_role", "_text", F.coalesce("_long", F.lit(False)).alias("_many"), "_first")
    order = ["_c", "_chunk", "_turn", "_role", "_text"]
    solved = stage(known.repartition("_c", "_chunk").sortWithinPartitions(*order).mapInArrow(_pieces(kind, span), _PIECE_SQL.format(name)), "pieces")

    parts = solved.where("_many").groupBy("_c").applyInArrow(_chained(kind), f"_c {name}, _chunk bigint, _sub int, _part string, {', '.join(f'{c} bigint' for c in _TOTALS)}, audit string")
    parts = stage(parts, "chained")
    edits = parts.select("_c", "_chunk", F.lit(0).alias("_what"), F.col("_sub").cast("long").alias("_turn"), F.lit(None).cast("string").alias("_role"), F.lit(None).cast("string").alias("_text"), "_part")
    texts = rows.join(wide, F.col("_c").eqNullSafe(F.col("_wc")), "left_semi").select("_c", "_chunk", F.lit(1).alias("_what"), "_turn", "_role", "_text", F.lit(None).cast("string").alias("_part"))
    digests = edits.union(texts).repartition("_c").sortWithinPartitions("_c", "_chunk", "_what", "_turn", "_role", "_text")
    digests = digests.select("_c", "_part", "_role", "_text").mapInArrow(_digests(kind), f"_c {name}, _sha string").withColumnRenamed("_c", "_dc")

    gaps = F.when(F.col("_low").isNull(), F.lit(0).cast("long")).otherwise(F.col("_high") - F.col("_low") + 1 - F.col("_turns"))
    way = F.col("_ways")[0]
    whole = solved.where(~F.col("_many")).select("_c", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", way["cost"].alias("cost"), way["audit"].alias("audit"), "_sha")
    pieced = parts.where(F.col("audit").isNotNull()).join(digests, F.col("_c").eqNullSafe(F.col("_dc"))).select("_c", *_TOTALS, "audit", "_sha")
    every = turns.select(F.col(conv_id).alias("_every")).distinct()
    found = every.join(whole.union(pieced), F.col("_every").eqNullSafe(F.col("_c")), "left")
    return found.select(
        F.col("_every").alias(conv_id),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _TOTALS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("_sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


#: Dynamic programming over rows and states; audits and texts travel with the costs.
ORACLE = r"""
WITH RECURSIVE o AS (SELECT coalesce(conv_id::VARCHAR, ' ') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT c, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 20 AS pick FROM o),
d AS (SELECT c, turn, CASE WHEN pick = 4 THEN 'user' ELSE role END AS role, CASE WHEN pick = 1 THEN '' WHEN pick = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN pick = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE pick <> 0),
r AS (SELECT c, turn, role, text, row_number() OVER w AS i, lag(role[:1]) OVER w AS prev
      FROM d WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text)),
q AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth FROM r),
f AS (SELECT *, role[:1] AS h, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM q),
p AS (SELECT c, 0::BIGINT AS i, unnest([{'st': 0, 'v': {'cost': 0, 'audit': '', 'txt': ''}}, {'st': 2, 'v': {'cost': 2, 'audit': 'I', 'txt': chr(10) || 'user:'}},
        {'st': 3, 'v': {'cost': 4, 'audit': 'II', 'txt': chr(10) || 'user:' || chr(10) || 'assistant:'}}], max_depth := 2) FROM (SELECT DISTINCT c FROM f)
  UNION ALL
  SELECT c, i, st, min(v) AS v FROM (
    SELECT c, i, unnest([{'st': st, 'v': {'cost': cost, 'audit': audit, 'txt': txt}},
        {'st': CASE WHEN st = 2 THEN 3 ELSE 2 END, 'v': {'cost': cost + 2, 'audit': audit || 'I', 'txt': txt || chr(10) || CASE WHEN st = 2 THEN 'assistant:' ELSE 'user:' END}},
        {'st': CASE WHEN st = 2 THEN 2 ELSE 3 END, 'v': {'cost': cost + 4, 'audit': audit || 'II', 'txt': txt || chr(10) || CASE WHEN st = 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END}}], max_depth := 2)
    FROM (
      SELECT p.c, f.i, unnest(list_filter([
          {'ok': true, 'st': st, 'cost': v.cost + 3, 'audit': v.audit || 'D', 'txt': v.txt},
          {'ok': fault NOT IN ('b', 'd') AND (h = 'u' AND st <> 2 OR h = 'a' AND st = 2 OR h = 's' AND st = 0), 'st': CASE h WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
           'cost': v.cost + CASE fault WHEN 't' THEN 1 ELSE 0 END, 'audit': v.audit || 'K', 'txt': v.txt || chr(10) || role || ':' || text},
          {'ok': fault NOT IN ('b', 'd'), 'st': CASE WHEN st = 2 THEN 3 ELSE 2 END,
           'cost': v.cost + 2 + CASE fault WHEN 't' THEN 1 ELSE 0 END, 'audit': v.audit || 'R', 'txt': v.txt || chr(10) || CASE WHEN st = 2 THEN 'assistant' ELSE 'user' END || ':' || text}
        ], lambda x: x.ok), max_depth := 2)
      FROM p JOIN f ON p.c = f.c AND f.i = p.i + 1)) GROUP BY c, i, st),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (prev IS NOT NULL AND prev || h NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
b AS (SELECT n.c, gaps, blank, duplicate, truncated, illegal, min(v) AS v FROM n JOIN p ON p.c = n.c AND p.i = n.n WHERE st IN (0, 3) GROUP BY ALL)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       coalesce(v.cost, 0)::BIGINT AS cost, coalesce(v.audit, '') AS audit, sha256(coalesce(v.txt[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN b ON b.c = coalesce(conv_id::VARCHAR, ' ')
"""
