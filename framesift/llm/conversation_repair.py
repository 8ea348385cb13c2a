"""Least repair of conversations: cost layers of reachable grammar states, in the manner of Wu and Manber.

The turns that are left after a repair must have the role initials `(s?(ua)+)?`. To keep a turn costs 0, to give it another role 2, to
delete it 3, to insert an empty one 2, and a truncated turn that stays 1 more; blank and repeated turns must go. A turn's layers are
bitsets: layer c holds the grammar states from which the turns from here on can be finished at cost c or less. A turn's layers follow
from those of the turn after it by shifts and tables. States never differ by more than five in cost, so six layers over the least cost hold all of
it, in one small number. The first layer with the start state gives the cost; a walk through the layers' bits, with the least letter first,
gives the audit: the edits' initials, the least in ASCII order among the cheapest.

Rows are dealt by ranges of (conversation, turn, role, text), so that a conversation of any length is cut over tasks, and each task cuts on at
PIECE turns or BYTES of text. A conversation within a task is solved there. Of the others each piece gives a short table, what it does to any
layers behind it; these tables alone are put together for a conversation, and its pieces are then solved anywhere, each by itself. Equal
rows are counted within a batch before they are dealt. Where the first of equal turns stands is found by an aggregation, and its row carries a
mark that is dealt with it, so no conversation or text that many rows share is joined by.

Nulls: a null text or role is one space, in the key of the damage a null id or turn too; null turns come first; null ids are one
conversation. Rows of one turn are ordered by role and the SHA-256 of their text. Repeated rows: all but the first are duplicates. Very long texts are a piece
each. Empty table: no rows. Other columns are not read, so they may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sliced, table

PIECE, BYTES = 4096, 4 << 20
LAYERS = 6
ROLES = {2: "user", 3: "assistant"}  # the role that leads to a state
#: States: start, after s, after u, after a. The state that a role's initial leads to.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
INSERT = {0: 2, 1: 2, 2: 3, 3: 2}
ACCEPT = (0, 3)
ORDER_OK = ("su", "ua", "au")
#: Codes of turns: 0 must go; 1 + 2 * initial + truncated else.
INITIALS = ("s", "u", "a", "")


def _before(to: dict[int, int]) -> list[int]:
    """For each set of states, those that the edges lead from into it."""
    return [sum(1 << q for q, t in to.items() if s >> t & 1) for s in range(16)]


BEFORE = {c: _before(to) for c, to in NEXT.items()}
BEFORE_INSERT = _before(INSERT)


def code(initial: str, must_go: bool, truncated: bool) -> int:
    return 0 if must_go else 1 + 2 * INITIALS.index(initial if initial in INITIALS else "") + truncated


def _packed(layers: list[int]) -> tuple[int, int]:
    """The least cost, and the layers from it on; layers grow, the last of them holds all states."""
    least = next(k for k, s in enumerate(layers) if s)
    out = (layers[least:] + layers[-1:] * LAYERS)[:LAYERS]
    return least, sum(s << 4 * k for k, s in enumerate(out))


def _closed(layers: list[int]) -> list[int]:
    """With what insertions reach, which cost 2."""
    for k in range(2, len(layers)):
        layers[k] |= BEFORE_INSERT[layers[k - 2]]
    return layers


def at(layers: int, k: int) -> int:
    return 0 if k < 0 else layers >> 4 * min(k, LAYERS - 1) & 15


def cost_of(layers: int, state: int) -> int:
    return next(k for k in range(LAYERS) if at(layers, k) >> state & 1)


END = _packed(_closed([sum(1 << q for q in ACCEPT)] * (LAYERS + 4)))[1]


@cache
def step(layers: int, turn: int) -> tuple[int, int]:
    """What a turn adds to the least cost, and the layers before it, from those after it."""
    if turn == 0:
        return 3, layers
    initial, late = INITIALS[(turn - 1) // 2], (turn - 1) % 2
    return _packed(_closed([BEFORE[initial][at(layers, k - late)] | BEFORE_INSERT[at(layers, k - 2 - late)] | at(layers, k - 3) for k in range(LAYERS + 4)]))


class Move(NamedTuple):
    letters: str
    state: int
    added: tuple[str, ...]  # roles of insertions
    role: str | None  # new role of the turn


@cache
def move(after: int, turn: int, state: int) -> Move:
    """The least letters from a state before a turn to behind it, along cheapest edits."""
    more, before = step(after, turn)
    letters, added = "", []
    initial, late = (INITIALS[(turn - 1) // 2], (turn - 1) % 2) if turn else ("", 0)
    while True:
        left = cost_of(before, state) + more
        if 3 + cost_of(after, state) == left:
            return Move(letters + "D", state, tuple(added), None)
        to = INSERT[state]
        if 2 + cost_of(before, to) + more == left:
            letters, state = letters + "I", to
            added.append(ROLES[to])
            continue
        kept = NEXT[initial].get(state)
        if kept is not None and cost_of(after, kept) + late == left:
            return Move(letters + "K", kept, tuple(added), None)
        return Move(letters + "R", to, tuple(added), ROLES[to])


@cache
def finish(state: int) -> tuple[str, tuple[str, ...]]:
    """Insertions behind the last turn."""
    added = []
    while state not in ACCEPT:
        state = INSERT[state]
        added.append(ROLES[state])
    return "I" * len(added), tuple(added)


@cache
def all_layers() -> tuple[int, ...]:
    """Every value that layers can have."""
    found, new = {END}, [END]
    while new:
        new = [x for x in {step(v, t)[1] for v in new for t in range(9)} if x not in found]
        found.update(new)
    return tuple(sorted(found))


def layers_of(turns: list[tuple[int, int]], end: int) -> tuple[int, list[int]]:
    """Cost beyond the end's least one, and the layers before each turn and at the end; turns: (code, how many such that must go follow)."""
    out, total = [end], 0
    for t, n in reversed(turns):
        more, before = step(out[-1], t)
        total += more + 3 * n
        out.append(before)
    return total, out[::-1]


def summary(turns: list[tuple[int, int]]) -> list[tuple[int, int, int, list[int]]]:
    """For any layers behind a piece: (these, cost, layers before it, state behind it from each state before it)."""
    out = []
    for end in all_layers():
        total, layers = layers_of(turns, end)
        states = list(range(4))
        for (t, _), after in zip(turns, layers[1:], strict=True):
            states = [move(after, t, q).state for q in states]
        out.append((end, total, layers[0], states))
    return out


class Item(NamedTuple):
    code: int
    gone: int  # repeated rows of it, which must go
    role: str
    text: str


def solve(items: list[Item], state: int, end: int, last: bool) -> tuple[int, str, list[tuple[str, str]]]:
    """Cost, audit and the turns that are left of a piece. The cost is counted from the state before it to the least one behind it."""
    turns = [(i.code, i.gone) for i in items]
    total, layers = layers_of(turns, end)
    cost = total + cost_of(layers[0], state)
    audit, left = [], []
    for i, after in zip(items, layers[1:], strict=True):
        m = move(after, i.code, state)
        audit.append(m.letters + "D" * i.gone)
        left += [(r, "") for r in m.added]
        if not m.letters.endswith("D"):
            left.append((m.role or i.role, i.text))
        state = m.state
    if last:
        letters, added = finish(state)
        audit.append(letters)
        left += [(r, "") for r in added]
    else:
        cost -= cost_of(layers[-1], state)
    return cost, "".join(audit), left


# rows


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text), nulls of role and text as a space, with `copies`: 0 dropped, 2 repeated; by crc32 of `conv_id:turn`."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), copies.alias("copies"))


ROWS = "conv_id long, turn long, role string, digest binary, first boolean, text string, copies long"
SPACES = " \t\n\r\x0b\x0c"


def counted(rows: DataFrame) -> DataFrame:
    """ROWS with equal rows of a batch in one. Dropped rows keep their conversation alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 20_000):
            t = pa.table({**dict(zip(b.schema.names, b.columns, strict=True)), "copies": b["copies"].cast(pa.int64())})
            gone = t.filter(pc.equal(t["copies"], 0)).group_by(["conv_id"], use_threads=False).aggregate([])
            seen = t.filter(pc.greater(t["copies"], 0)).group_by(["conv_id", "turn", "role", "text"], use_threads=False).aggregate([("copies", "sum")])
            digests = [hashlib.sha256(x.encode()).digest() for x in seen["text"].to_pylist()]
            n, m = len(seen), len(gone)
            yield from pa.table(
                {
                    "conv_id": pa.chunked_array([*seen["conv_id"].chunks, *gone["conv_id"].chunks], pa.int64()),
                    "turn": pa.chunked_array([*seen["turn"].chunks, pa.nulls(m, pa.int64())], pa.int64()),
                    "role": pa.chunked_array([*seen["role"].chunks, pa.nulls(m, pa.string())], pa.string()),
                    "digest": pa.array(digests + [None] * m, pa.binary()),
                    "first": pa.array([False] * (n + m)),
                    "text": pa.chunked_array([*seen["text"].chunks, pa.nulls(m, pa.string())], pa.string()),
                    "copies": pa.chunked_array([*seen["copies_sum"].chunks, pa.array([0] * m, pa.int64())], pa.int64()),
                }
            ).combine_chunks().to_batches()

    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies").mapInArrow(run, ROWS)


def with_marks(rows: DataFrame) -> DataFrame:
    """rows and, for the first of equal turns (role and text) of a conversation, a mark: a row with its keys and `first`."""
    place = F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn"))
    marks = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(place.alias("p"))
    marks = marks.select("conv_id", F.col("p.turn").alias("turn"), "role", "digest", F.lit(True).alias("first"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"))
    return rows.unionByName(marks)


PIECES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("no", pa.int64()), ("whole", pa.bool_()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("n_turns", pa.int64())]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")]
    + [("head", pa.string()), ("tail", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("codes", pa.list_(pa.int64()))]
    + [("turns", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), ("effect", pa.list_(pa.int64()))]
)
PIECES_SQL = (
    "conv_id long, part int, no long, whole boolean, first_turn long, last_turn long, n_turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, "
    "cost long, audit string, codes array<long>, turns array<struct<role: string, text: string>>, effect array<long>"
)


class Piece:
    """Turns of one conversation, in order."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.items: list[Item] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first_turn = self.last_turn = self.head = self.tail = self.key = None
        self.n_turns = self.size = 0
        self.marked = False

    def add(self, turn, role: str, text: str, copies: int, first: bool) -> None:
        """`first`: no equal turn stands before."""
        last = text.rstrip(SPACES)[-1:]
        must_go = not last or not first
        late = not must_go and last not in ".!?"
        extra = copies if must_go else copies - 1
        self.counts["duplicate" if last else "blank"] += extra
        self.counts["truncated"] += late
        initial = role[:1]
        self.counts["illegal"] += copies - 1  # none of the pairs is one of equal initials
        if self.tail is None:
            self.head = initial
        else:
            self.counts["illegal"] += self.tail + initial not in ORDER_OK
        self.tail = initial
        if turn is not None and turn != self.last_turn:
            self.n_turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.items.append(Item(code(initial, must_go, late), copies - 1, role, "" if must_go else text))
        self.size += len(self.items[-1].text)

    def row(self, part: int, no: int, whole: bool) -> dict:
        out = {"conv_id": self.conv_id, "part": part, "no": no, "whole": whole, "first_turn": self.first_turn, "last_turn": self.last_turn, "n_turns": self.n_turns, "head": self.head, "tail": self.tail}
        out |= self.counts
        if whole:
            out["cost"], out["audit"], left = solve(self.items, 0, END, True)
            return out | {"codes": None, "turns": [{"role": r, "text": t} for r, t in left], "effect": None}
        turns = [(i.code, i.gone) for i in self.items]
        effect = [x for end, total, before, states in summary(turns) for x in (end, total, before, *states)]
        return out | {"cost": None, "audit": None, "codes": [x for t in turns for x in t], "turns": [{"role": i.role, "text": i.text} for i in self.items], "effect": effect}


def pieces(rows: DataFrame) -> DataFrame:
    """PIECES of marked rows: whole conversations solved, others with what is needed to solve them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        weight, now, number, serial = 0, None, 0, 0

        def taken(whole: bool) -> None:
            nonlocal weight, serial
            out.append(now.row(part, serial, whole))
            weight += now.size + 200 * len(now.items)
            serial += 1

        def batch() -> pa.RecordBatch:
            nonlocal weight
            got = pa.RecordBatch.from_pylist(out, schema=PIECES)
            out.clear()
            weight = 0
            return got

        seen = 0  # conversations begun here; the first and the last may go on elsewhere
        for b in sliced(it, 5_000):
            columns = [b[c].to_pylist() for c in ("conv_id", "turn", "role", "digest", "first", "text", "copies")]
            for conv, turn, role, digest, first, text, copies in zip(*columns, strict=True):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        taken(whole=seen > 1 and number == 0)
                    now, number, seen = Piece(conv), 0, seen + 1
                if first:
                    now.marked = True
                    continue
                if copies:
                    if len(now.items) >= PIECE or now.size >= BYTES:
                        marked = now.marked
                        taken(whole=False)
                        number += 1
                        now = Piece(conv)
                        now.marked = marked
                    now.add(turn, role, text, copies, now.marked)
                    now.marked = False
                if weight >= BYTES:
                    yield batch()
        if now is not None:
            taken(whole=False)
        if out:
            yield batch()

    keys = ["conv_id", "turn", "role", "digest"]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("first").desc())
    return dealt.mapInArrow(run, PIECES_SQL)


def plan(open_pieces: DataFrame) -> DataFrame:
    """(part, no, state, end, last) of each piece of cut conversations, from what the pieces do to layers: a few numbers for PIECE turns."""

    def run(key, t):
        t = t.sort_by([("part", "ascending"), ("no", "ascending")])
        effects = [{e[i]: e[i + 1 : i + 7] for i in range(0, len(e), 7)} for e in t["effect"].to_pylist()]
        ends = [END]
        for e in reversed(effects[1:]):
            ends.append(e[ends[-1]][1])
        ends.reverse()
        states = [0]
        for e, end in zip(effects[:-1], ends, strict=False):
            states.append(e[end][2 + states[-1]])
        return pa.table({"part": t["part"], "no": t["no"], "state": pa.array(states, pa.int32()), "end": pa.array(ends, pa.int64()), "last": pa.array([False] * (len(ends) - 1) + [True])})

    return open_pieces.select("conv_id", "part", "no", "effect").groupBy("conv_id").applyInArrow(run, "part int, no long, state int, end long, last boolean")


def solved(open_pieces: DataFrame) -> DataFrame:
    """PIECES of cut conversations with costs, audits and the turns that are left."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(it, 16):
            out = b.to_pylist()
            for r in out:
                codes = r["codes"]
                items = [Item(*codes[2 * k : 2 * k + 2], t["role"], t["text"]) for k, t in enumerate(r["turns"])]
                r["cost"], r["audit"], left = solve(items, r.pop("state"), r.pop("end"), r.pop("last"))
                r["turns"], r["codes"], r["effect"] = [{"role": a, "text": t} for a, t in left], None, None
            yield pa.RecordBatch.from_pylist(out, schema=PIECES)

    return open_pieces.join(plan(open_pieces), ["part", "no"]).select(*PIECES.names, "state", "end", "last").mapInArrow(run, PIECES_SQL)


def repair(rows: DataFrame) -> DataFrame:
    """Repaired conversations of rows (conv_id, turn, role, text, copies), a row for each piece, in order of (part, no) in a conversation: the turns
    that are left, the audit, the cost and counts. `whole`: the piece is all of its conversation."""
    found = cut(pieces(with_marks(counted(rows))), "pieces")
    return found.where("whole").unionByName(solved(found.where("not whole")))


DIGEST = pa.schema(
    [("conv_id", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def digest(repaired: DataFrame) -> DataFrame:
    """A row for each conversation; its pieces are read in order, one at a time."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None

        def done() -> dict:
            n = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["distinct"]
            return {c: now[c] for c in DIGEST.names if c in now} | {"gaps": n, "audit": "".join(now["letters"]), "repaired_sha256": sha.hexdigest()}

        for b in sliced(it, 500):
            out = []
            for r in b.to_pylist():
                if now is None or r["whole"] or now["whole"] or now["conv_id"] != r["conv_id"]:
                    if now is not None:
                        out.append(done())
                    sha = hashlib.sha256()
                    now = {"conv_id": r["conv_id"], "whole": r["whole"], "low": None, "high": None, "distinct": 0, "tail": None, "left": 0, "letters": []}
                    now |= dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    now[c] += r[c]
                now["letters"].append(r["audit"])
                if r["head"] is not None:
                    now["illegal"] += now["tail"] is not None and now["tail"] + r["head"] not in ORDER_OK
                    now["tail"] = r["tail"]
                if r["n_turns"]:
                    now["distinct"] += r["n_turns"] - (now["high"] == r["first_turn"])
                    now["low"] = r["first_turn"] if now["low"] is None else now["low"]
                    now["high"] = r["last_turn"]
                for t in r["turns"]:
                    sha.update((("\n" if now["left"] else "") + f"{t['role']}:{t['text']}").encode())
                    now["left"] += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=DIGEST)
        if now is not None:
            yield pa.RecordBatch.from_pylist([done()], schema=DIGEST)

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    whole = repaired.where("whole").mapInArrow(run, schema)
    return whole.unionByName(repaired.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part", "no").mapInArrow(run, schema))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(repair(damage(table(spark, sf_dir, "conversations"))))


ORACLE_SQL = r"""
WITH RECURSIVE crc(t) AS (SELECT list(v ORDER BY n) FROM (SELECT n, list_reduce(list_concat([n::UBIGINT], range(8)::UBIGINT[]), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) r(n))),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (
  SELECT src.*, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(key, ''), lambda c: ascii(c)::UBIGINT)), lambda h, b: xor(h >> 8, t[((xor(h, b) & 255) + 1)::BIGINT])), 4294967295) % 20 AS kind FROM src, crc),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos, right(regexp_replace(text, '[ \t-\r]+$', ''), 1) AS tip FROM damaged),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS again FROM placed),
f AS (SELECT *, left(role, 1) AS i, CASE WHEN tip = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN tip NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM numbered),
linked AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au') AS odd FROM f),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal FROM linked GROUP BY conv_id),
all_of AS (SELECT c.conv_id, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
walk(conv_id, pos, v0, v1, v2, v3) AS (
  SELECT conv_id, n + 1, {'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''} FROM all_of
  UNION ALL
  SELECT conv_id, pos, list_min([w0, {'c': c2.c + 2, 'a': 'I' || c2.a}]), list_min([w1, {'c': c2.c + 2, 'a': 'I' || c2.a}]), c2, c3 FROM (
    SELECT *, list_min([w2, {'c': w3.c + 2, 'a': 'I' || w3.a}]) AS c2, list_min([w3, {'c': w2.c + 2, 'a': 'I' || w2.a}]) AS c3 FROM (
      SELECT w.conv_id, f.pos,
        list_min([{'c': v0.c + 3, 'a': 'D' || v0.a}, CASE WHEN stay AND i = 's' THEN {'c': v1.c + late, 'a': 'K' || v1.a} WHEN stay AND i = 'u' THEN {'c': v2.c + late, 'a': 'K' || v2.a} END, CASE WHEN stay THEN {'c': v2.c + 2 + late, 'a': 'R' || v2.a} END]) AS w0,
        list_min([{'c': v1.c + 3, 'a': 'D' || v1.a}, CASE WHEN stay AND i = 'u' THEN {'c': v2.c + late, 'a': 'K' || v2.a} END, CASE WHEN stay THEN {'c': v2.c + 2 + late, 'a': 'R' || v2.a} END]) AS w1,
        list_min([{'c': v2.c + 3, 'a': 'D' || v2.a}, CASE WHEN stay AND i = 'a' THEN {'c': v3.c + late, 'a': 'K' || v3.a} END, CASE WHEN stay THEN {'c': v3.c + 2 + late, 'a': 'R' || v3.a} END]) AS w2,
        list_min([{'c': v3.c + 3, 'a': 'D' || v3.a}, CASE WHEN stay AND i = 'u' THEN {'c': v2.c + late, 'a': 'K' || v2.a} END, CASE WHEN stay THEN {'c': v2.c + 2 + late, 'a': 'R' || v2.a} END]) AS w3
      FROM walk w JOIN (SELECT *, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS stay, coalesce(fault = 'truncated', false)::INT AS late FROM f) f
        ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos - 1))),
best AS (SELECT conv_id, v0.c AS cost, v0.a AS audit FROM walk WHERE pos = 1),
letters AS (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best),
edits AS (SELECT conv_id, substr(audit, k, 1) AS l, length(regexp_replace(left(audit, k), 'I', '', 'g')) AS pos, length(regexp_replace(left(audit, k), 'D', '', 'g')) AS nth, length(regexp_replace(audit, 'D', '', 'g')) AS total FROM letters),
lines AS (
  SELECT e.conv_id, nth, CASE WHEN l = 'K' THEN f.role WHEN (total + nth) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE f.text END AS line
  FROM edits e LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.pos = e.pos WHERE l <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY nth) AS text FROM lines GROUP BY conv_id)
SELECT a.conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, cost::BIGINT AS cost, audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM all_of a JOIN best b ON a.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON a.conv_id IS NOT DISTINCT FROM t.conv_id
"""
