"""Two passes over decoded video: samples find where something changed, then the gaps before are filled in and all is numbered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import change_magnitude
from ..shared import cut
from . import align, numbering
from .cascade import cascade, prev_keyframes, to_manifest


def second_pass(frames: DataFrame, s: Settings) -> DataFrame:
    """Sampled frames, and those between a skipped sample and a keyframe after it. The first pass writes and redacts nothing."""
    sampled = numbering.coarse_sample(frames, "seq_pos", F.col("fps"), s.video.sample_fps)
    gaps = gaps_of(sampled, s)
    return sampled.unionByName(numbering.backfill(frames, gaps, "seq_id", "seq_pos"))


def gaps_of(sampled: DataFrame, s: Settings) -> DataFrame:
    decided = cascade(sampled, s).select("seq_id", "seq_pos", "is_keyframe")
    return numbering.transitions(decided, "seq_id", "seq_pos", "seq_pos")


def process(frames: DataFrame, settings: Settings | None = None, segments: DataFrame | None = None, speech: DataFrame | None = None) -> DataFrame:
    """Manifest rows, with seq_id, seq_pos and frame, of frames (seq_id: the video, seq_pos: frame number, fps, duration, frame).

    segments: transcript cues, of all videos where they name none; speech: (source_video, seg_pos, start, end, text). Keyframes are named step_001 and on
    by video, and their pictures lie in a folder of the video, so that videos don't overwrite each other's."""
    s = settings or Settings()
    return enriched(cut(second_pass(frames, s), "chosen"), s, segments, speech)


def process_files(spark: SparkSession, paths: list[str], settings: Settings | None = None, segments: DataFrame | None = None, speech: DataFrame | None = None) -> DataFrame:
    """The same of video files, of which only the samples and the gaps are decoded, each once."""
    from ..sources import video_source

    s = settings or Settings()
    sampled = cut(video_source.read_videos(spark, paths, s.video.sample_fps), "sampled")
    gaps = cut(gaps_of(sampled, s), "gaps")
    chosen = sampled.unionByName(cut(video_source.gap_frames(gaps, paths), "filled"))
    return enriched(chosen.select("seq_id", "seq_pos", "fps", "duration", "frame"), s, segments, speech)


def _with_transcript(rows: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """Texts are found by times alone and joined to the rows, so that pictures aren't gathered by time."""
    times = rows.select("seq_id", "seq_pos", *[c for c in (key, "video_timestamp") if c != "seq_id"])
    words = align.align_transcript(times, segments, key, "video_timestamp", ["seq_id", "seq_pos"], unique=True)
    return rows.join(words.select("seq_id", "seq_pos", "transcript_segment"), ["seq_id", "seq_pos"], "left")


def enriched(chosen: DataFrame, s: Settings, segments: DataFrame | None, speech: DataFrame | None) -> DataFrame:
    """Manifest rows of the chosen frames, with numbers, names, transcripts and speech."""
    info = chosen.select("seq_id", "seq_pos", "fps", "duration", "frame")
    rows = cascade(chosen.drop("fps", "duration"), s).drop("keyframe_index", "total_keyframes", "time_since_prev_keyframe", "video_timestamp", "video_duration", "source_video", "transcript_segment", "audio_activity", "prev_keyframe_id", "prev_keyframe_path")
    rows = rows.join(info, ["seq_id", "seq_pos"]).withColumn("video_timestamp", F.col("seq_pos") / F.col("fps")).withColumn("video_duration", F.col("duration"))
    rows = numbering.number_keyframes(rows, "seq_id", "seq_pos")
    rows = numbering.time_since_prev(rows, "seq_id", "seq_pos", "video_timestamp")
    step = F.format_string("step_%03d", "keyframe_index")
    folder = F.regexp_replace("seq_id", "[^A-Za-z0-9._-]", "_")
    path = F.concat(F.lit(s.exporter.output_dir.rstrip("/") + "/"), folder, F.lit("/"), step, F.lit(f".{s.exporter.keyframe_format}"))
    rows = rows.withColumn("frame_id", F.when(F.col("is_keyframe"), step).otherwise(F.format_string("frame_%06d", "seq_pos"))).withColumn("asset_path", F.when(F.col("is_keyframe"), path))
    rows = prev_keyframes(rows).withColumn("source_video", F.col("seq_id")).withColumn("video_frame_number", F.col("seq_pos").cast("int")).withColumn("source_format", F.lit("video"))
    rows = rows.withColumn("change_magnitude", F.when(F.col("is_keyframe"), change_magnitude(F.col("ssim_score"), F.col("changed_regions"))))
    word = spoken = cued = None
    if segments is not None:
        if "source_video" in segments.columns:
            rows = _with_transcript(rows, segments, "source_video")
            rows = rows.join(segments.select("source_video").distinct().withColumn("_cued", F.lit(True)), "source_video", "left")
            cued = F.coalesce("_cued", F.lit(False))
        else:  # one transcript for all: joined by time alone
            one = {"_transcript": F.lit(0)}
            rows = _with_transcript(rows.withColumns(one), segments.withColumns(one), "_transcript")
            cued = segments.agg((F.count("*") > 0).alias("cued")).scalar()
        word = F.col("transcript_segment")
        rows = rows.withColumn("transcript_segment", F.when(F.col("is_keyframe"), word))
    if speech is not None:
        rows = align.has_speech(rows, speech, "source_video", "video_timestamp", ["seq_id", "seq_pos"])
        spoken = F.col("in_speech")
    activity = align.audio_activity(F.col("is_keyframe"), word, spoken, s.video.audio_detection, cued)
    rows = rows.withColumn("audio_activity", activity)
    return to_manifest(rows, "seq_id", "seq_pos", "frame")
