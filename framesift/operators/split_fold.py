"""The cascade of sequences that are too long for a task: segments are folded from a guess, then stitched.

Frames are dealt by ranges of (seq_id, seq_pos), so a long sequence is cut over tasks. Each task folds what it has as if a sequence began
with its first frame. Only the first and the last run of a task can belong to a sequence that goes on elsewhere: these edges, two for
each task, are all that the driver sees. An edge that continues a sequence is folded again, from the mask's state at the end of the edge
before and from its last keyframe, beside the guess. As soon as both masks have the same state and both folds keep the same frame, the
rest of the guess is right, and the fold stops. Where that doesn't come before an edge's end, the next edge begins otherwise than was
thought and is folded again in another round; after n rounds the first n edges of a sequence are right, so it ends. Mostly one
round is enough, and only frames up to the EARLY-th keyframe of a segment are read for it.

Frames are read once for the guess, and their beginnings again in each round, so they should be a table that is cheap to read. seq_pos is
unique in a sequence. Sequences within a task are done in the first pass.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Settings
from ..functions import imaging
from ..shared import cut
from .cascade import DECISION, Features, Walk, pixels_of

#: Keyframe of the guess up to which a segment is read at first.
EARLY = 8
BATCH = 256
#: On the last row of an edge: the mask's state behind it, the place, id and mask of the last keyframe, and if the guess holds from there on.
STATE = T.StructType([T.StructField("mask", T.BinaryType()), T.StructField("pos", T.LongType()), T.StructField("id", T.StringType()), T.StructField("regions", T.BinaryType()), T.StructField("met", T.BooleanType())])


class Tracked(Walk):
    """A walk that knows where its last keyframe is and how that was masked."""

    def __init__(self, s: Settings):
        super().__init__(s)
        self.at: int | None = None
        self.regions: list = []

    def step_at(self, pos: int, frame, frame_id: str | None, means=None) -> dict:
        out = self.step(frame, frame_id, means)
        if out["is_keyframe"]:
            self.at, self.regions = pos, [tuple(r.values()) for r in out["adaptive_mask"] or []]
        return out

    def state(self, met: bool = False) -> dict:
        return {"mask": self.mask.dump(), "pos": self.at, "id": self.kept, "regions": pickle.dumps(self.regions), "met": met}


def batched(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == BATCH:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def guesses(frames: DataFrame, settings: Settings, keep: list[str], tasks: int) -> DataFrame:
    """frames with decisions as if each run of a task were a sequence; part, run, nth (keyframes of the run so far) and the state behind edges."""
    fields = [*(frames.schema[c] for c in keep), *DECISION.fields, T.StructField("part", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("nth", T.LongType()), T.StructField("state", STATE)]
    schema = to_arrow_schema(T.StructType(fields))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, run, seq, held, walk, nth = TaskContext.get().partitionId(), -1, None, None, None, 0
        for b in it:
            kept = b.select(keep).to_pylist()
            for r, s, pos, name, frame in zip(kept, *(b[c].to_pylist() for c in ("seq_id", "seq_pos", "frame_id")), pixels_of(b), strict=True):
                if held is None or s != seq:
                    if held is not None:
                        yield held | {"state": walk.state() if run == 0 else None}
                    seq, walk, run, nth = s, Tracked(settings), run + 1, 0
                else:
                    yield held
                d = walk.step_at(pos, frame, name)
                nth += d["is_keyframe"]
                held = r | d | {"part": part, "run": run, "nth": nth, "state": None}
        if held is not None:
            yield held | {"state": walk.state()}

    dealt = frames.select(*dict.fromkeys([*keep, "seq_id", "seq_pos", "frame_id", "frame"])).repartitionByRange(tasks, "seq_id", "seq_pos").sortWithinPartitions("seq_id", "seq_pos")
    return dealt.mapInArrow(lambda it: batched(rows(it), schema), T.StructType(fields))


@dataclass
class Edge:
    """A run at the beginning or the end of a task. behind: the state after it, of which round `version` has the mask's."""

    seq: str | None
    part: int
    run: int
    lo: int
    hi: int
    early: int
    behind: dict
    before: Edge | None = None
    version: int = 0
    begun_from: tuple | None = None
    limit: int = 0
    final: tuple[int, int] | None = None
    guessed: dict | None = None


def edges_of(guess: DataFrame) -> list[Edge]:
    """Two for each task at most, in order, each linked to the one that it continues."""
    state = F.max_by(F.struct("state.pos", "state.id", "state.regions"), F.when(F.col("state").isNotNull(), F.col("seq_pos")))
    found = guess.groupBy("part", "run").agg(
        F.first("seq_id").alias("seq"), F.min("seq_pos").alias("lo"), F.max("seq_pos").alias("hi"), F.min(F.when((F.col("nth") == EARLY) & F.col("is_keyframe"), F.col("seq_pos"))).alias("early"), state.alias("behind"), F.count("state").alias("n")
    )
    out: list[Edge] = []
    for r in found.where("n > 0").orderBy("part", "run").collect():
        e = Edge(r.seq, r.part, r.run, r.lo, r.hi, r.hi if r.early is None else r.early, r.behind.asDict())
        if out and e.run == 0 and out[-1].part != e.part and out[-1].seq == e.seq:
            e.before = out[-1]
        e.limit, e.guessed = e.early, e.behind
        out.append(e)
    return out


GROUPS = "g int, g_seq string, lo long, hi long, kf_pos long, kf_id string, kf_regions binary, state_pos long, version int"


def refolded(frames: DataFrame, states: DataFrame, groups: DataFrame, n: int, settings: Settings) -> DataFrame:
    """(g, seq_id, seq_pos, decision, state) of each group's frames until the guess is met."""
    g = F.broadcast(groups)  # two rows for each task at most
    of = F.col("seq_id").eqNullSafe(F.col("g_seq"))
    first = states.join(g, of & (F.col("seq_pos") == F.col("state_pos")) & (F.col("of_version") == F.col("version")))
    first = first.select("g", F.lit(0).alias("kind"), "seq_id", "seq_pos", F.lit(None).cast("string").alias("frame_id"), F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"), F.col("state.mask").alias("given"))
    keyframe = F.col("seq_pos") == F.col("kf_pos")
    rest = frames.join(g, of & (keyframe | F.col("seq_pos").between(F.col("lo"), F.col("hi"))))
    rest = rest.select("g", F.when(keyframe, 1).otherwise(2).alias("kind"), "seq_id", "seq_pos", F.when(keyframe, F.col("kf_id")).otherwise(F.col("frame_id")).alias("frame_id"), "frame", F.when(keyframe, F.col("kf_regions")).alias("given"))
    fields = [T.StructField("g", T.IntegerType()), T.StructField("seq_id", T.StringType()), T.StructField("seq_pos", T.LongType()), *DECISION.fields, T.StructField("state", STATE)]
    schema = to_arrow_schema(T.StructType(fields))

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, held, true, guess, met = None, None, None, None, False
        for b in it:
            columns = (b[c].to_pylist() for c in ("g", "kind", "seq_id", "seq_pos", "frame_id", "given"))
            for group, kind, seq, pos, name, given, frame in zip(*columns, pixels_of(b), strict=True):
                if group != now:
                    if held is not None:
                        yield held | {"state": true.state(met)}
                    now, held, true, guess, met = group, None, Tracked(settings), Tracked(settings), False
                if kind == 0:
                    true.mask.load(given)
                elif kind == 1:
                    true.at, true.kept, true.regions = pos, name, pickle.loads(given)
                    true.fold.last = Features.of(imaging.blank(frame, true.regions), settings)
                elif not met:
                    if held is not None:
                        yield held
                    means = imaging.block_means(frame, true.block)
                    d, other = true.step_at(pos, frame, name, means), guess.step_at(pos, frame, name, means)
                    held = {"g": group, "seq_id": seq, "seq_pos": pos, "state": None} | d
                    met = d["is_keyframe"] and other["is_keyframe"] and true.mask.same(guess.mask)
        if held is not None:
            yield held | {"state": true.state(met)}

    dealt = first.unionByName(rest).repartitionById(n, "g").sortWithinPartitions("g", "kind", "seq_pos")
    return dealt.mapInArrow(lambda it: batched(rows(it), schema), T.StructType(fields))


def decide_split(frames: DataFrame, settings: Settings, keep: list[str], tasks: int) -> DataFrame:
    """What cascade.decide gives, of frames with sequences of any length, dealt over so many tasks."""
    spark = frames.sparkSession
    guess = cut(guesses(frames, settings, keep, tasks), "guess")
    names = [f.name for f in DECISION.fields]
    edges = edges_of(guess)
    seen = frames.select("seq_id", "seq_pos", "frame_id", "frame")
    states = guess.where("state is not null").select("seq_id", "seq_pos", "state", F.lit(0).alias("of_version"))
    done: list[DataFrame] = []
    todo = [e for e in edges if e.before]
    while todo:
        version = len(done) + 1
        for e in todo:
            e.begun_from = (e.before.version, e.before.behind)
        groups = [(i, e.seq, e.lo, e.limit, e.before.behind["pos"], e.before.behind["id"], e.before.behind["regions"], e.before.hi, e.before.version) for i, e in enumerate(todo)]
        got = cut(refolded(seen, states, spark.createDataFrame(groups, GROUPS), len(groups), settings), "refolded")
        ends = {r.g: r.state for r in got.where("state is not null").select("g", F.struct("state.pos", "state.id", "state.regions", "state.met").alias("state")).collect()}
        again = []
        for i, e in enumerate(todo):
            met = ends[i].met
            e.final = (version, i)
            if not met and e.limit < e.hi:
                e.limit = e.hi  # the guess wasn't met so early: all of it
                again.append(e)
            elif met:
                e.behind, e.version = e.guessed, 0
            else:
                e.behind, e.version = {c: ends[i][c] for c in ("pos", "id", "regions")}, version
        states = states.unionByName(got.where("state is not null").select("seq_id", "seq_pos", "state", F.lit(version).alias("of_version")))
        done.append(got)
        todo = again + [e for e in edges if e.before and e not in again and e.begun_from != (e.before.version, e.before.behind)]
    if not done:
        return guess.select(*keep, *names)
    mended = None
    for version, got in enumerate(done, 1):
        last = [e.final[1] for e in edges if e.final and e.final[0] == version]
        rows = got.where(F.col("g").isin(last)).select(F.col("seq_id").alias("_seq"), F.col("seq_pos").alias("_pos"), F.struct(*names).alias("_new"))
        mended = rows if mended is None else mended.unionByName(rows)
    both = guess.join(mended, F.col("seq_id").eqNullSafe(F.col("_seq")) & (F.col("seq_pos") == F.col("_pos")), "left")
    return both.select(*keep, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in names])
