"""Queries of the library's operators over the plain tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import pictures
from ..operators import align, cascade, masking, numbering, pii
from ..shared import file_system, shared_dir
from ..sources import media
from ..streaming import keyframes as streaming
from . import virtual as V

ALL_TYPES = [p.name for p in pii.BUILTIN]
FPS, SAMPLE_FPS, SCALAR_STEP = 30, 10.0, 50.0
CUSTOM = [pii.Pattern("license", r"\b(?:MIT|Apache|GPL)\b"), pii.Pattern("ip_address", "", enabled=False)]


def _reg(found={}):  # noqa: B006
    def add(f):
        found[f.__name__] = f
        return f

    add.found = found
    return add


query = _reg()
QUERIES = query.found


# frames: loading, blocks, hashes, comparison


@query
def frame_load(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf).withColumn("m", C.channel_means(F.col("frame")))
    return f.select("vec_id", F.col("frame.height").alias("height"), F.col("frame.width").alias("width"), F.length("frame.data").alias("n_bytes"), F.round(F.col("m")[0], 4).alias("mean"))


@query
def block_means(spark: SparkSession, sf: str) -> DataFrame:
    cells = V.frames(spark, sf).select("vec_id", F.posexplode(C.block_means(F.col("frame"), V.BLOCK)).alias("i", "mean")).where("i % 3 = 0")
    n = V.SIDE // V.BLOCK
    b = F.floor(F.col("i") / 3)
    return cells.select("vec_id", F.floor(b / n).cast("int").alias("r"), (b % n).cast("int").alias("c"), F.round(F.col("mean").cast("double"), 4).alias("mean"))


@query
def channel_means(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf).withColumn("m", C.channel_means(F.col("frame")))
    return f.select("vec_id", *[F.round(F.col("m")[i], 4).alias(f"mean_{c}") for i, c in enumerate("rgb")])


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return V.with_previous(V.frames(spark, sf), "frame")


def _diffs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("vec_id", F.size(C.block_diff(F.col("frame"), F.col("prev_frame"), V.BLOCK)).alias("n_changed"))


@query
def changed_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _diffs(spark, sf)


@query
def changed_pct(spark: SparkSession, sf: str) -> DataFrame:
    return _diffs(spark, sf).select("vec_id", F.round(F.col("n_changed") / F.lit((V.SIDE // V.BLOCK) ** 2) * 100, 4).alias("changed_pct"))


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    return V.frames(spark, sf).select("vec_id", "label", C.phash(F.col("frame"), V.HASH).alias("perceptual_hash"))


@query
def phash(spark: SparkSession, sf: str) -> DataFrame:
    return _hashed(spark, sf).select("vec_id", "perceptual_hash")


def _tall(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of a label's frames, one above the other."""
    n = F.row_number().over(V.by_label()) - 1
    g = V.frames(spark, sf).withColumn("pair", F.floor(n / 2).cast("int")).groupBy("label", "pair").agg(F.array_sort(F.collect_list(F.struct("vec_id", "frame.data"))).alias("f")).where(F.size("f") == 2)
    frame = F.struct(F.lit(2 * V.SIDE).alias("height"), F.lit(V.SIDE).alias("width"), F.concat(F.col("f")[0]["data"], F.col("f")[1]["data"]).alias("data"))
    return g.select("label", "pair", frame.alias("frame")).withColumn("tiles", C.phash_tiles(F.col("frame"), size=V.HASH))


@query
def phash_tiled(spark: SparkSession, sf: str) -> DataFrame:
    tall = C.is_tall(F.col("frame.height"), F.col("frame.width"))
    return _tall(spark, sf).select("label", "pair", tall.alias("tall"), F.size("tiles").alias("n_tiles"), F.col("tiles")[0].alias("hash_1"), F.col("tiles")[1].alias("hash_2"))


@query
def hamming(spark: SparkSession, sf: str) -> DataFrame:
    h = V.with_previous(_hashed(spark, sf), "perceptual_hash")
    return h.select("vec_id", C.hamming(F.col("perceptual_hash"), F.col("prev_perceptual_hash")).cast("int").alias("distance"))


@query
def hash_match(spark: SparkSession, sf: str) -> DataFrame:
    h = V.with_previous(_hashed(spark, sf), "perceptual_hash")
    return h.select("vec_id", *[C.hash_match(F.col("perceptual_hash"), F.col("prev_perceptual_hash"), t).alias(f"match_{t}") for t in (0, 1, 2)])


@query
def tiled_match(spark: SparkSession, sf: str) -> DataFrame:
    t = _tall(spark, sf).withColumn("before", F.lag("tiles").over(Window.partitionBy("label").orderBy("pair"))).where("before is not null")
    return t.select("label", "pair", *[C.tiles_match(F.col("tiles"), F.col("before"), n).alias(f"match_{n}") for n in (0, 2)])


@query
def ssim_prev(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("vec_id", F.round(C.ssim(F.col("prev_frame"), F.col("frame")), 4).alias("ssim_score"))


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("vec_id", C.compare(F.col("frame"), F.col("prev_frame"), V.BLOCK).alias("c"))


@query
def compare_frames(spark: SparkSession, sf: str) -> DataFrame:
    c = _compared(spark, sf)
    return c.select("vec_id", *[F.round(F.col(f"c.{x}"), 4).alias(x) for x in ("ssim_score", "change_score", "changed_pct")], F.size("c.changed_regions").alias("n_changed"))


@query
def change_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    c = _compared(spark, sf)
    return c.select("vec_id", C.change_magnitude(F.col("c.ssim_score"), F.col("c.changed_regions")).alias("change_magnitude"))


@query
def keyframe_predicate(spark: SparkSession, sf: str) -> DataFrame:
    c, s = _compared(spark, sf), V.settings().comparator
    return c.select("vec_id", C.is_keyframe(F.col("c.ssim_score"), F.size("c.changed_regions"), s.ssim_threshold, s.min_changed_blocks).alias("is_keyframe"))


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id").cast("int")
    region = F.struct((v % 13 - 4).alias("x"), (v % 11 - 4).alias("y"), (v % 7 + 1).alias("w"), (v % 5 + 1).alias("h"))
    return V.table(spark, sf, "embeddings").select("vec_id", region.alias("region"))


@query
def region_area(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf).select("vec_id", C.area(F.col("region")).alias("area"))


@query
def region_clamp(spark: SparkSession, sf: str) -> DataFrame:
    return _regions(spark, sf).select("vec_id", F.inline(F.array(C.clamp(F.col("region"), F.lit(V.SIDE), F.lit(V.SIDE)))))


@query
def box_from_quad(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "embeddings")
    at = lambda i: F.floor((F.col("embedding")[i].cast("double") + 1) * 100)
    return e.select("vec_id", F.inline(F.array(C.box_of_quad(F.array(*[F.array(at(2 * i), at(2 * i + 1)) for i in range(4)])))))


# masks


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    s = V.settings(noise_threshold=0.8)
    return cascade.with_masks(V.frames(spark, sf), s)


@query
def adaptive_mask(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("adaptive_mask").isNull(), 0).otherwise(F.size("adaptive_mask"))
    return _masked(spark, sf).select("vec_id", n.alias("n_masked"))


@query
def mask_regions(spark: SparkSession, sf: str) -> DataFrame:
    return _masked(spark, sf).select("vec_id", F.inline("adaptive_mask"))


@query
def mask_apply(spark: SparkSession, sf: str) -> DataFrame:
    f = cascade.apply_masks(_masked(spark, sf), "vec_id")
    f = f.select("vec_id", C.channel_means(F.col("frame")).alias("m"))
    return f.select("vec_id", F.round(F.col("m")[0], 4).alias("mean"))


@query
def mask_reset(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "embeddings").select("vec_id", "label", (F.floor(F.col("vec_id") / 37) % 3 * 8).cast("int").alias("height"), F.lit(16).alias("width"))
    return masking.segments(e, block=8, seq="label", pos="vec_id").select("vec_id", F.col("segment").cast("int").alias("segment"))


# the cascade


def _cascade(spark: SparkSession, sf: str) -> DataFrame:
    f = V.frames(spark, sf).withColumn("frame_id", F.col("vec_id").cast("string"))
    return cascade.cascade(f, V.settings())


@query
def cascade_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade(spark, sf).select(F.col("seq_pos").alias("vec_id"), "is_keyframe", "event_type", F.round("ssim_score", 4).alias("ssim_score"))


@query
def cascade_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade(spark, sf).select(F.col("seq_pos").alias("vec_id"), "visual_reason")


@query
def prev_keyframe_links(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade(spark, sf).select(F.col("seq_pos").alias("vec_id"), "prev_keyframe_id", "prev_keyframe_path")


@query
def keyframe_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _cascade(spark, sf).where("is_keyframe").select("frame_id", "asset_path", "changed_pct").withColumn("changed_pct", F.round("changed_pct", 4))


@query
def task_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = numbering.summary(_cascade(spark, sf), "seq_id")
    return s.select("seq_id", "num_frames", "num_keyframes", F.round("skip_rate", 6).alias("skip_rate"), F.round("keyframe_pct", 1).alias("keyframe_pct"))


@query
def global_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = numbering.summary(_cascade(spark, sf))
    return s.select(F.col("num_frames").alias("total_frames"), F.col("num_keyframes").alias("total_keyframes"), F.round("skip_rate", 6).alias("skip_rate"))


@query
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    c = numbering.number_keyframes(_cascade(spark, sf).drop("keyframe_index", "total_keyframes"), "seq_id", "seq_pos")
    n = F.when(F.col("changed_regions").isNotNull(), F.size("changed_regions"))
    mag = F.when(F.col("is_keyframe"), C.change_magnitude(F.col("ssim_score"), F.col("changed_regions")))
    c = cascade.to_manifest(c.withColumn("change_magnitude", mag).withColumn("_n", n), "seq_id", "_n")
    flat = c.withColumn("changed_regions", F.col("_n")).withColumn("adaptive_mask", F.col("adaptive_mask").isNotNull()).drop("_n")
    return flat.withColumns({x: F.round(x, 4) for x in ("ssim_score", "change_score", "changed_pct")})


def _with_regions(c: DataFrame) -> DataFrame:
    """The columns of a cascade that masks reach, regions as text."""
    text = lambda a: F.array_join(F.transform(a, lambda r: F.concat_ws(":", r["x"], r["y"], r["w"], r["h"])), ",").alias(a)
    return c.select(F.col("seq_pos").alias("vec_id"), "is_keyframe", F.round("ssim_score", 4).alias("ssim_score"), text("changed_regions"), text("adaptive_mask"), "prev_keyframe_id", "visual_reason")


@query
def cascade_masked(spark: SparkSession, sf: str) -> DataFrame:
    """With blocks masked, which hashes, gate and comparison then see."""
    f = V.frames(spark, sf).withColumn("frame_id", F.col("vec_id").cast("string"))
    return _with_regions(cascade.cascade(f, V.settings(noise_threshold=0.6)))


@query
def cascade_tall(spark: SparkSession, sf: str) -> DataFrame:
    """Tall frames, two of a label's one above the other, whose tiles have hashes of their own."""
    n = F.row_number().over(V.by_label()) - 1
    g = V.frames(spark, sf).withColumn("pair", F.floor(n / 2)).groupBy("seq_id", "pair").agg(F.array_sort(F.collect_list(F.struct("vec_id", "frame.data"))).alias("f")).where(F.size("f") == 2)
    frame = F.struct(F.lit(2 * V.SIDE).alias("height"), F.lit(V.SIDE).alias("width"), F.concat(F.col("f")[0]["data"], F.col("f")[1]["data"]).alias("data"))
    tall = g.select("seq_id", F.col("f")[0]["vec_id"].alias("seq_pos"), F.col("f")[0]["vec_id"].cast("string").alias("frame_id"), frame.alias("frame"))
    s = V.settings(noise_threshold=0.6)
    s.comparator.min_changed_blocks = 28
    c = cascade.cascade(tall, s)
    return _with_regions(c).join(c.select(F.col("seq_pos").alias("vec_id"), "perceptual_hash"), "vec_id")


@query
def cascade_split(spark: SparkSession, sf: str) -> DataFrame:
    """All frames as one sequence, dealt over eight tasks."""
    f = V.frames(spark, sf).withColumn("frame_id", F.col("vec_id").cast("string")).withColumn("seq_id", F.lit("all"))
    return _with_regions(cascade.cascade(f, V.settings(noise_threshold=0.6), split=8))


@query
def scalar_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    e = V.table(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return cascade.scalar_keyframes(e, "user_id", ["ts", "event_id"], "value", SCALAR_STEP).select("event_id", "is_keyframe", "ref_value")


@query
def stream_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    """The same fold as a stream that reads what is there and ends; its rows go to the shared folder."""
    out = shared_dir(spark, "stream")
    source = V.table(spark, sf, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parquet*")
    rows = streaming.stream_scalar_keyframes(events, "user_id", ["ts", "event_id"], "value", SCALAR_STEP)
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "is_keyframe", "ref_value")


# sampling, numbering


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return V.events(spark, sf).withColumn("is_keyframe", F.col("event_type").isin("purchase", "signup"))


def _sampled(spark: SparkSession, sf: str) -> DataFrame:
    return numbering.coarse_sample(_flagged(spark, sf), "frame_no", FPS, SAMPLE_FPS)


@query
def coarse_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _sampled(spark, sf).select("event_id", "user_id", "frame_no")


@query
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    return numbering.transitions(_sampled(spark, sf), "user_id", "frame_no", "frame_no")


@query
def backfill(spark: SparkSession, sf: str) -> DataFrame:
    gaps = numbering.transitions(_sampled(spark, sf), "user_id", "frame_no", "frame_no")
    return numbering.backfill(_flagged(spark, sf), gaps, "user_id", "frame_no").select("event_id", "user_id", "frame_no")


@query
def ordered_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Sampled and filled-in frames of a second pass, numbered in frame order."""
    f = _flagged(spark, sf)
    gaps = numbering.transitions(_sampled(spark, sf), "user_id", "frame_no", "frame_no")
    both = _sampled(spark, sf).unionByName(numbering.backfill(f, gaps, "user_id", "frame_no"))
    return both.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("frame_no")).alias("merged_no"))


@query
def range_scan(spark: SparkSession, sf: str) -> DataFrame:
    return V.events(spark, sf).where("frame_no >= 10 and frame_no < 20").select("event_id", "user_id", "frame_no", F.round(F.col("frame_no") / FPS, 6).alias("video_timestamp"))


@query
def keyframe_index(spark: SparkSession, sf: str) -> DataFrame:
    n = numbering.number_keyframes(_flagged(spark, sf), "user_id", "frame_no").where("is_keyframe")
    return n.select("event_id", "keyframe_index", F.format_string("step_%03d", "keyframe_index").alias("frame_id"))


@query
def total_keyframes(spark: SparkSession, sf: str) -> DataFrame:
    return numbering.number_keyframes(_flagged(spark, sf), "user_id", "frame_no").select("event_id", "total_keyframes")


@query
def time_since_prev(spark: SparkSession, sf: str) -> DataFrame:
    t = numbering.time_since_prev(_flagged(spark, sf), "user_id", "frame_no", "secs").where("is_keyframe")
    return t.select("event_id", F.round("time_since_prev_keyframe", 3).alias("time_since_prev_keyframe"))


@query
def prior_action(spark: SparkSession, sf: str) -> DataFrame:
    return numbering.prior(V.events(spark, sf), "user_id", "frame_no", "event_type", "action").select("event_id", "action")


@query
def first_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return numbering.first_groups(V.events(spark, sf), "user_id", ["ts", "event_id"], 10).select("event_id", "user_id", "frame_no")


# sound and transcripts


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return V.events(spark, sf).select("user_id", F.col("frame_no").alias("chunk"), (F.col("value") - 100).alias("dbfs"), ((F.max("frame_no").over(Window.partitionBy("user_id")) + 1) * 0.5).alias("duration"))


@query
def speech_runs(spark: SparkSession, sf: str) -> DataFrame:
    return align.speech_segments(_chunks(spark, sf), "user_id").select("user_id", "seg_pos", "start", "end", "text")


def _speech(spark: SparkSession, sf: str) -> DataFrame:
    e = V.events(spark, sf).where("event_type = 'purchase'")
    return e.select("user_id", F.col("frame_no").alias("seg_pos"), F.col("secs").alias("start"), (F.col("secs") + 3600).alias("end"), F.concat_ws("-", "event_type", "event_id").alias("text"))


@query
def audio_activity(spark: SparkSession, sf: str) -> DataFrame:
    p = align.has_speech(_flagged(spark, sf), _speech(spark, sf), "user_id", "secs", ["event_id"])
    return p.select("event_id", align.audio_activity(F.col("is_keyframe"), None, F.col("in_speech")).alias("audio_activity"))


@query
def transcript_align(spark: SparkSession, sf: str) -> DataFrame:
    p = V.events(spark, sf).select("event_id", "user_id", "secs")
    return align.align_transcript(p, _speech(spark, sf), "user_id", "secs", ["event_id"]).select("event_id", "transcript_segment")


@query
def transcript_activity(spark: SparkSession, sf: str) -> DataFrame:
    a = align.align_transcript(_flagged(spark, sf), _speech(spark, sf), "user_id", "secs", ["event_id"])
    return a.select("event_id", align.audio_activity(F.col("is_keyframe"), F.col("transcript_segment"), None).alias("audio_activity"))


def _subtitles(spark: SparkSession, sf: str) -> DataFrame:
    """A subtitle text for each conversation: five seconds a turn."""
    c = V.table(spark, sf, "conversations")
    t = F.col("turn") * 5
    stamp = lambda s, ms: F.format_string(f"%02d:%02d:%02d,{ms}", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    cue = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), stamp(t, "250"), F.lit(" --> "), stamp(t + 4, "500"), F.lit("\n"), F.regexp_replace(F.col("text"), "\n\\s*\n", "\n"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", cue.alias("cue")))), lambda x: x["cue"]), "\n\n").alias("srt"))


@query
def transcript_parse(spark: SparkSession, sf: str) -> DataFrame:
    cues = media.parse_transcripts(_subtitles(spark, sf), "srt", F.lit(False), "conv_id")
    return cues.select("conv_id", "start", "end", "text")


@query
def vtt_parse(spark: SparkSession, sf: str) -> DataFrame:
    subs = _subtitles(spark, sf).withColumn("srt", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.col("srt")))
    return media.parse_transcripts(subs, "srt", F.lit(True), "conv_id").groupBy("conv_id").agg(F.count("*").alias("n_cues"), F.max("end").alias("last_end"))


# personal data


def _patterns() -> list[pii.Pattern]:
    return pii.pattern_set(ALL_TYPES)


@query
def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pii.counts(V.table(spark, sf, "documents"), "text", _patterns()).select("doc_id", *[f"n_{n}" for n in ALL_TYPES])


@query
def pii_counts_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pii.counts(V.table(spark, sf, "pages"), "html", _patterns()).select("page_id", *[f"n_{n}" for n in ALL_TYPES])


@query
def pii_matches(spark: SparkSession, sf: str) -> DataFrame:
    return pii.found(V.table(spark, sf, "documents"), "text", _patterns(), "doc_id").groupBy("doc_id", "pattern", "matched").agg(F.count("*").alias("n"))


@query
def pii_flag(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", pii.has_pii(F.col("text"), _patterns()).alias("pii_detected"))


@query
def pii_redact_text(spark: SparkSession, sf: str) -> DataFrame:
    return V.table(spark, sf, "documents").select("doc_id", F.md5(pii.redact_text(F.col("text"), _patterns())).alias("redacted_md5"))


@query
def pii_custom_patterns(spark: SparkSession, sf: str) -> DataFrame:
    chosen = pii.pattern_set([*ALL_TYPES, "license"], CUSTOM)
    return pii.found(V.table(spark, sf, "documents"), "text", chosen, "doc_id").groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))


@query
def pii_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Matches with their offsets."""
    return V.table(spark, sf, "documents").select("doc_id", F.inline(pii.spans(F.col("text"), _patterns())))


# pictures, text recognition and frame streams: no SQL counterpart


def _picture_dir(spark: SparkSession, sf: str, folder: Column) -> str:
    """PNG files of all frames, in a new shared folder."""
    from ..sources import sinks

    out = shared_dir(spark, "pictures")
    asset = F.concat(F.lit(f"{out}/"), folder, F.format_string("frame_%012d.png", "vec_id"))
    sinks.save_keyframes(V.frames(spark, sf).select("frame", F.lit(True).alias("is_keyframe"), asset.alias("asset_path"))).agg(F.sum("n_bytes")).collect()
    return out


@query
def image_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures written by the sink and read by the directory source, all in one directory."""
    from ..sources import images

    f = images.frames_from_dir(spark, _picture_dir(spark, sf, F.lit(""))).withColumn("m", C.channel_means(F.col("frame")))
    return f.select(F.regexp_extract("frame_id", "_0*([0-9]+)$", 1).cast("long").alias("vec_id"), "source_format", F.col("seq_pos").cast("int").alias("seq_pos"), F.round(F.col("m")[0], 4).alias("mean"))


@query
def image_scan_all(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a directory for each label, each a sequence."""
    from ..sources import images

    folder = F.concat(F.lit("label_"), F.coalesce(F.col("label").cast("string"), F.lit("none")), F.lit("/"))
    f = images.frames_from_dir(spark, _picture_dir(spark, sf, folder), nested=True).withColumn("m", C.channel_means(F.col("frame")))
    label = F.regexp_extract("seq_id", "label_(-?[0-9]+)$", 1)
    return f.select(
        F.when(label != "", label).cast("int").alias("label"), F.regexp_extract("frame_id", "_0*([0-9]+)$", 1).cast("long").alias("vec_id"), "source_format", F.col("seq_pos").cast("int").alias("seq_pos"), F.round(F.col("m")[0], 4).alias("mean")
    )


def fake_engine():
    """Stands in for text recognition: reads an address in the left half of any picture that is dark there."""

    def read(a):
        w = a.shape[1] // 2
        dark = a[:, :w].mean() < 120
        return [([[0, 0], [w, 0], [w, a.shape[0]], [0, a.shape[0]]], "mail a@b.example" if dark else "nothing", 0.9)]

    return read


@query
def ocr_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Redaction of keyframes with a stand-in for the recognition engine."""
    c = _cascade(spark, sf).select(F.col("seq_pos").alias("vec_id"), "is_keyframe", "changed_regions")
    f = V.frames(spark, sf).select("vec_id", "frame").join(c, "vec_id")
    r = pii.redact_keyframes(f, _patterns(), fake_engine, scope="full")
    return r.withColumn("m", C.channel_means(F.col("frame"))).select("vec_id", "is_keyframe", "pii_detected", F.round(F.col("m")[0], 4).alias("mean"))


@query
def stream_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """The frame cascade as a stream with keyed state."""
    from ..sources.images import frames_from_gray

    out = shared_dir(spark, "stream")
    source = V.table(spark, sf, "embeddings")
    live = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/embeddings.parquet*")
    f = frames_from_gray(live, V.pixels(F.col("embedding")), V.SIDE, V.SIDE, "label", "vec_id").select("seq_id", "seq_pos", "frame.height", "frame.width", "frame.data")
    rows = streaming.stream_cascade(f, V.settings())
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.col("seq_pos").alias("vec_id"), "is_keyframe", "event_type", F.round("ssim_score", 4).alias("ssim_score"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """(third, value): a JSON message for each frame, and in which third of its sequence it is."""
    w = V.by_label()
    third = F.floor(3 * (F.row_number().over(w) - 1) / F.count("*").over(Window.partitionBy("label"))).cast("int")
    f = V.frames(spark, sf).withColumn("third", third)
    fields = {"sequence": "seq_id", "position": "seq_pos", "frame_id": F.col("vec_id").cast("string"), "app_name": F.lit("editor"), "image": F.base64(C.png(F.col("frame")))}
    return f.select("third", F.to_json(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()])).alias("value"))


@query
def stream_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Frames as JSON messages in three runs of a stream, each from the checkpoint of the one before; rows of the manifest that it leaves."""
    from ..streaming.sink import run_stream

    out = shared_dir(spark, "stream")
    s = V.settings(noise_threshold=0.6)
    s.exporter.output_dir = f"{out}/manifest"
    for third in range(3):
        _messages(spark, sf).where(F.col("third") == third).select("value").write.mode("append").text(f"{out}/in")
        run_stream(spark, f"{out}/in", s, glob="*.txt")
    m = spark.read.parquet(f"{s.exporter.output_dir}/manifest")
    return _with_regions(m).join(m.select(F.col("seq_pos").alias("vec_id"), "late", "app_name", "keyframe_index", "total_keyframes"), "vec_id")


@query
def picture_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Frames encoded and decoded in columns."""
    f = V.frames(spark, sf).select("vec_id", "frame", C.png(F.col("frame")).alias("picture"))
    d = f.select("vec_id", "frame", pictures.decoded(F.col("picture")).alias("d"))
    same = F.col("d.frame.data") == F.col("frame.data")
    return d.select("vec_id", "d.frame.height", "d.frame.width", "d.error", same.alias("same"), F.round(C.channel_means(F.col("d.frame"))[0], 4).alias("mean"))


def _video_dir(spark: SparkSession, sf: str) -> str:
    """Uncompressed gray videos, one for each label, in a new shared folder; a task writes a video frame by frame."""
    out = shared_dir(spark, "videos")

    def run(it):
        now, file, n = None, None, 0
        for b in it:
            for seq, frame in zip(b["seq_id"].to_pylist(), cascade.pixels_of(b), strict=True):
                if file is None or seq != now:
                    if file:
                        file.close()
                    fs, name = file_system(f"{out}/label_{seq}.y4m")
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    now, file = seq, fs.open_output_stream(name)
                    file.write(f"YUV4MPEG2 W{frame.shape[1]} H{frame.shape[0]} F{FPS}:1 Cmono\n".encode())
                file.write(b"FRAME\n" + frame[..., 0].tobytes())
                n += 1
        if file:
            file.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    f = V.frames(spark, sf).select("seq_id", "seq_pos", "frame").repartition("seq_id").sortWithinPartitions("seq_id", "seq_pos")
    f.mapInArrow(run, "n long").agg(F.sum("n")).collect()
    return out


@query
def video_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Samples and a range of frames of video files, with what the files say of themselves."""
    from ..sources.video_source import read_videos

    folder = _video_dir(spark, sf)
    sampled = read_videos(spark, [folder], SAMPLE_FPS, 16).withColumn("part", F.lit("sample"))
    ranged = read_videos(spark, [folder], None, 16).where("seq_pos >= 10 and seq_pos < 20").withColumn("part", F.lit("range"))
    both = sampled.unionByName(ranged).withColumn("m", C.channel_means(F.col("frame")))
    return both.select("part", F.regexp_extract("seq_id", "label_(.*)[.]y4m", 1).alias("label"), "seq_pos", "width", "height", "total_frames", F.round("duration", 6).alias("duration"), F.round(F.col("m")[0], 4).alias("mean"))


@query
def sql_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frame functions, in SQL alone."""
    from .. import sql

    sql.register(spark)
    V.frames(spark, sf).createOrReplaceTempView("framesift_frames")
    return spark.sql("""
        WITH pairs AS (SELECT vec_id, frame, lag(frame) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM framesift_frames),
        scored AS (SELECT vec_id, phash(frame, 2) AS h, phash(prev, 2) AS p, ssim(prev, frame) AS s, block_diff(frame, prev, 2) AS regions, mean_diff(channel_means(frame), channel_means(prev)) AS d FROM pairs WHERE prev IS NOT NULL)
        SELECT vec_id, frame_hamming(h, p) AS distance, hash_match(h, p, 0) AS match_0, hash_match(h, p, 2) AS match_2, round(s, 4) AS ssim_score, size(regions) AS n_changed, change_magnitude(s, size(regions)) AS change_magnitude,
          round(d, 4) AS mean_diff, region_area(get(regions, 0)) AS first_area FROM scored""")


@query
def sql_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of transcripts by a lateral join, and personal data in them, in SQL alone."""
    from .. import sql

    sql.register(spark)
    _subtitles(spark, sf).createOrReplaceTempView("framesift_subtitles")
    return spark.sql("""
        SELECT conv_id, kind, seg_pos, start, `end`, text, has_pii(text) AS has_pii, md5(redact_pii(text)) AS redacted_md5, size(find_pii(text)) AS n_found FROM (
          SELECT conv_id, 'srt' AS kind, t.* FROM framesift_subtitles, LATERAL parse_transcript(srt, false) AS t
          UNION ALL
          SELECT conv_id, 'vtt' AS kind, t.* FROM framesift_subtitles, LATERAL parse_transcript('WEBVTT\nKind: captions\n\n' || srt, true) AS t)""")


def _files(df: DataFrame, path: str, content: str) -> None:
    """Writes each row's text to a file of its own, from the tasks."""
    def run(it):
        for b in it:
            for name, text in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                fs, plain = file_system(name)
                fs.create_dir(plain.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(plain) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    df.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, "n long").agg(F.sum("n")).collect()


@query
def metadata_attach(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata from JSON files: one beside each frame (every seventh is no JSON), one for each task, whose actions are shifted by a frame."""
    from ..sources import sidecars

    out = shared_dir(spark, "sidecars")
    f = V.frames(spark, sf).select("vec_id", "seq_id", "seq_pos", F.format_string("f%012d", "vec_id").alias("frame_id"))
    side = F.to_json(F.struct(F.concat(F.lit("app"), F.col("vec_id") % 5).alias("app_name"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("vec_id")).alias("timestamp"), (F.col("vec_id") % 3).alias("other")))
    text = F.when(F.col("vec_id") % 7 == 0, "no json").otherwise(side)
    _files(f.withColumn("path", F.format_string(f"{out}/frames/%s.json", "frame_id")).withColumn("text", text), "path", "text")
    action = F.struct((F.row_number().over(V.by_label()) - 1).cast("int").alias("step_index"), F.concat(F.lit("op"), F.col("vec_id")).alias("operation"))
    actions = V.frames(spark, sf).select("seq_id", action.alias("a")).groupBy("seq_id").agg(F.slice(F.array_sort(F.collect_list("a")), 1, 20).alias("actions"))
    meta = actions.withColumn("text", F.to_json(F.struct(F.concat(F.lit("site"), F.col("seq_id")).alias("website"), F.concat(F.lit("do "), F.col("seq_id")).alias("confirmed_task"), "actions")))
    _files(meta.withColumn("path", F.concat(F.lit(f"{out}/tasks/"), F.col("seq_id"), F.lit("/metadata.json"))), "path", "text")
    beside = sidecars.attach_sidecars(f, sidecars.sidecars(spark, f"{out}/frames")).withColumnsRenamed({"app_name": "side_app", "window_title": "side_title"})
    both = sidecars.attach_tasks(beside, sidecars.tasks(spark, f"{out}/tasks"))
    return both.select("vec_id", "side_app", "side_title", F.unix_seconds("timestamp").alias("seconds"), "app_name", "window_title", F.col("action.operation").alias("action"))


def _masked_cascade(spark: SparkSession, sf: str, out: str | None = None) -> DataFrame:
    s = V.settings(noise_threshold=0.6)
    s.exporter.output_dir = out or s.exporter.output_dir
    return cascade.cascade(V.frames(spark, sf).withColumn("frame_id", F.col("vec_id").cast("string")), s)


@query
def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest with its 30 columns, masks on; regions as text."""
    c = _masked_cascade(spark, sf)
    text = lambda a: F.array_join(F.transform(a, lambda r: F.concat_ws(":", r["x"], r["y"], r["w"], r["h"])), ",")
    m = cascade.to_manifest(c)
    return m.withColumns({"changed_regions": text("changed_regions"), "adaptive_mask": text("adaptive_mask")} | {x: F.round(x, 4) for x in ("ssim_score", "change_score", "changed_pct")})


@query
def missing_pictures(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a manifest against the files of its folder: of every fifth keyframe the picture is missing, one file in eleven is of no row."""
    from ..sources import sidecars, sinks

    out = shared_dir(spark, "pictures")
    rows = _masked_cascade(spark, sf, out).select("seq_pos", "is_keyframe", "asset_path")
    pictures_ = rows.where("is_keyframe and seq_pos % 5 <> 0").join(V.frames(spark, sf).select("seq_pos", "frame"), "seq_pos")
    more = F.concat(F.lit(f"{out}/more/"), F.col("seq_pos"), F.lit(".png"))
    more = V.frames(spark, sf).where("seq_pos % 11 = 0").select("seq_pos", F.lit(True).alias("is_keyframe"), more.alias("asset_path"), "frame")
    sinks.save_keyframes(pictures_.unionByName(more)).agg(F.sum("n_bytes")).collect()
    files = sidecars.listing(spark, out, "*.png")
    name = lambda c: F.regexp_extract(c, "([0-9]+)[.]png$", 1).cast("long").alias("vec_id")
    there = sidecars.with_files(rows, files).where("asset_path_exists and asset_path_bytes > 0").select(F.lit("there").alias("what"), F.col("seq_pos").alias("vec_id"))
    gone = sidecars.missing_files(rows, files).select(F.lit("missing").alias("what"), F.col("seq_pos").alias("vec_id"))
    return there.unionByName(gone).unionByName(sidecars.unknown_files(files, rows).select(F.lit("unknown").alias("what"), name("path")))


@query
def result_documents(spark: SparkSession, sf: str) -> DataFrame:
    """JSON of each task and of all."""
    from ..operators import results

    rows = _masked_cascade(spark, sf).select("seq_id", "seq_pos", "frame_id", "event_type", "is_keyframe", "perceptual_hash", "adaptive_mask", "prev_keyframe_id")
    return results.task_documents(rows).unionByName(results.summary_document(rows).withColumn("seq_id", F.lit(None).cast("string")))
