"""Spark types of frames, regions and the manifest."""

from __future__ import annotations

from pyspark.sql import types as T

KEYFRAME, SKIPPED = "KEYFRAME", "SKIPPED"

REGION = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x", "y", "w", "h")])
REGIONS = T.ArrayType(REGION)
FRAME = T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("data", T.BinaryType())])
SEGMENT = T.StructType(
    [T.StructField("source_video", T.StringType()), T.StructField("seg_pos", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())]
)

_S, _B, _I, _D = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType()
MANIFEST = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("frame_id", _S), ("timestamp", T.TimestampType()), ("event_type", _S), ("app_name", _S), ("window_title", _S), ("is_keyframe", _B), ("perceptual_hash", _S),
            ("ssim_score", _D), ("change_score", _D), ("changed_pct", _D), ("changed_regions", REGIONS), ("adaptive_mask", REGIONS), ("frame_width", _I), ("frame_height", _I),
            ("source_format", _S), ("asset_path", _S), ("pii_detected", _B), ("visual_reason", _S), ("prev_keyframe_id", _S), ("prev_keyframe_path", _S), ("source_video", _S),
            ("video_timestamp", _D), ("video_frame_number", _I), ("time_since_prev_keyframe", _D), ("audio_activity", _S), ("transcript_segment", _S), ("keyframe_index", _I),
            ("total_keyframes", _I), ("video_duration", _D), ("change_magnitude", _S),
        )
    ]
)
