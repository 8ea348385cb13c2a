"""Speech and transcript alignment: interval joins on time buckets, and runs by islands and gaps."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(points: DataFrame, segments: DataFrame, key: str, time: str, bucket_s: float) -> tuple[DataFrame, DataFrame]:
    """points with their time bucket _b, and the segments for each (_key, _bucket) that they touch.

    A bucket is as wide as segments are long on average, bucket_s at least, so there are three rows a segment at most on average. The
    mean is of whole seconds, as a sum of fractions may depend on the order of rows and both sides must see one width."""
    valid = segments.where("start <= end")
    mean = F.try_divide(F.sum(F.ceil(F.col("end") - F.col("start"))), F.count("*"))
    width = valid.agg(F.greatest(F.lit(bucket_s), mean).alias("_width")).scalar()
    b = lambda t: F.floor(t / width)
    touched = F.explode(F.sequence(b(F.col("start")), b(F.col("end"))))
    spread = valid.withColumn("_bucket", touched).select(F.col(key).alias("_key"), "_bucket", "seg_pos", "start", "end", "text")
    return points.withColumn("_b", b(F.col(time))), spread


def in_intervals(points: DataFrame, segments: DataFrame, key: str, time: str, bucket_s: float = 60.0) -> DataFrame:
    """points joined with the segments (key, seg_pos, start, end, text) that hold them, both ends included.

    Segments are spread over the time buckets they touch, so it is an equi-join on (key, bucket) however many segments there are."""
    at, spread = _buckets(points, segments, key, time, bucket_s)
    hit = (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_bucket")) & (F.col(time) >= F.col("start")) & (F.col(time) <= F.col("end"))
    return at.join(spread, hit).drop("_key", "_bucket", "_b")


def align_transcript(points: DataFrame, segments: DataFrame, key: str, time: str, id_cols: list[str], unique: bool = False, bucket_s: float = 60.0) -> DataFrame:
    """points with transcript_segment: texts of all segments that hold them, in file order, joined by ' | '; null for none.

    Points go to the lists of segments of their buckets and texts are joined there, so what is shuffled is points and segments, not
    the pairs of them, of which there may be many for each point. Points of one id share their texts, and those without an id have
    none; only pairs of repeated ids are shuffled. unique: no id is null or repeated. Wide rows had better be joined to their texts."""
    columns = points.columns
    if not unique:
        slim = points.select(*id_cols, *[c for c in (key, time) if c not in id_cols])
        repeated = slim.withColumn("_n", F.count("*").over(Window.partitionBy(*id_cols))).where("_n > 1").drop("_n")
        texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "text"))), lambda x: x["text"]), " | ")
        points = points.join(in_intervals(repeated, segments, key, time, bucket_s).groupBy(*id_cols).agg(texts.alias("_shared")), id_cols, "left")
    at, spread = _buckets(points, segments, key, time, bucket_s)
    lists = spread.groupBy("_key", "_bucket").agg(F.array_sort(F.collect_list(F.struct("seg_pos", "text", "start", "end"))).alias("_list"))
    held = F.filter("_list", lambda x: (x["start"] <= F.col(time)) & (F.col(time) <= x["end"]))
    found = at.join(lists, (F.col(key) == F.col("_key")) & (F.col("_b") == F.col("_bucket")), "left").withColumn("_held", held)
    text = F.when(F.size("_held") > 0, F.array_join(F.transform("_held", lambda x: x["text"]), " | "))
    if not unique:
        known = reduce(and_, [F.col(c).isNotNull() for c in id_cols])
        text = F.when(known, F.coalesce("_shared", text))
    return found.select(*columns, text.alias("transcript_segment"))


def has_speech(points: DataFrame, speech: DataFrame, key: str, time: str, id_cols: list[str]) -> DataFrame:
    """points with in_speech."""
    hit = in_intervals(points.select(*id_cols, *[c for c in (key, time) if c not in id_cols]), speech, key, time).select(*id_cols).distinct().withColumn("_hit", F.lit(True))
    return points.join(hit, id_cols, "left").withColumn("in_speech", F.coalesce("_hit", F.lit(False))).drop("_hit")


def audio_activity(keyframe: Column, transcript: Column | None, in_speech: Column | None, detection: bool = True, has_cues: Column | None = None) -> Column:
    """A transcript decides if it has cues (has_cues; without that, it is taken to have some); else the speech found; else silence if
    detection is on. Keyframes only."""
    word = lambda c: F.when(c, "speech").otherwise("silence")
    if in_speech is not None:
        value = word(in_speech)
    else:
        value = F.lit("silence") if detection else F.lit(None).cast("string")
    if transcript is not None:
        by_transcript = word(F.coalesce(transcript != "", F.lit(False)))
        value = by_transcript if has_cues is None else F.when(has_cues, by_transcript).otherwise(value)
    return F.when(keyframe, value)


def runs(df: DataFrame, seq: str, pos: str, flag: Column) -> DataFrame:
    """(seq, first, last, n) of each run of rows with the flag."""
    w = Window.partitionBy(seq).orderBy(pos)
    numbered = df.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_n", F.row_number().over(w))
    island = F.col("_n") - F.row_number().over(w)
    return numbered.where("_f").withColumn("_i", island).groupBy(seq, "_i").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count("*").alias("n")).drop("_i")


def speech_segments(chunks: DataFrame, key: str, chunk_s: float = 0.5, least_dbfs: float = -40.0) -> DataFrame:
    """Segments of consecutive loud chunks (key, chunk, dbfs, duration): start and end in seconds; a last run ends with the sound."""
    total = chunks.groupBy(key).agg(F.max("duration").alias("_total"))
    found = runs(chunks, key, "chunk", F.col("dbfs") > least_dbfs).join(total, key)
    out = found.select(key, (F.col("first") * chunk_s).alias("start"), F.least((F.col("last") + 1) * chunk_s, F.col("_total")).alias("end"), F.lit("[speech]").alias("text"))
    return out.withColumn("seg_pos", F.row_number().over(Window.partitionBy(key).orderBy("start")) - 1)
