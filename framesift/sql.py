"""The library's functions by name, for queries that are written in SQL alone.

register(spark) makes them temporary functions of the session. Where an expression does, the function is one, and Catalyst sees through it; where
pixels are read it is an Arrow function. parse_transcript is a table function for lateral joins.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import columns as C
from .functions import imaging, pictures
from .operators import pii
from .schema import FRAME, REGIONS
from .sources.media import TIME

#: name, parameters, type, expression.
EXPRESSIONS = [
    ("frame_hamming", "a STRING, b STRING", "INT", "bit_count(CAST(conv(a, 16, -10) AS BIGINT) ^ CAST(conv(b, 16, -10) AS BIGINT))"),
    ("hash_match", "a STRING, b STRING, tolerance INT", "BOOLEAN", "CASE WHEN tolerance = 0 THEN a = b ELSE frame_hamming(a, b) <= tolerance END"),
    ("mean_diff", "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "array_max(zip_with(a, b, (x, y) -> abs(x - y)))"),
    ("is_tall", "height INT, width INT, ratio DOUBLE", "BOOLEAN", "height > width * ratio"),
    ("region_area", "r STRUCT<x: INT, y: INT, w: INT, h: INT>", "INT", "r.w * r.h"),
    ("change_magnitude", "ssim DOUBLE, n INT", "STRING", "CASE WHEN ssim IS NULL THEN 'major' WHEN ssim < 0.70D OR n > 15 THEN 'major' WHEN ssim < 0.90D OR n > 5 THEN 'moderate' ELSE 'minor' END"),
    ("transcript_seconds", "t STRING", "DOUBLE", "CAST(substr(t, 1, 2) AS INT) * 3600 + CAST(substr(t, 4, 2) AS INT) * 60 + CAST(replace(substr(t, 7), ',', '.') AS DOUBLE)"),
]
_STAMP = TIME.replace("\\", "\\\\")
_TEXT = r"replace(coalesce(content, ''), '\r\n', '\n')"
_BODY = rf"CASE WHEN is_vtt AND trim(split({_TEXT}, '\n', 2)[0]) LIKE 'WEBVTT%' THEN regexp_extract({_TEXT}, '(?s)\\A.*?\\n[ \\t]*\\n(.*)\\z', 1) ELSE {_TEXT} END"
TRANSCRIPT = rf"""CREATE OR REPLACE TEMPORARY FUNCTION parse_transcript(content STRING, is_vtt BOOLEAN) RETURNS TABLE (seg_pos INT, start DOUBLE, end DOUBLE, text STRING) RETURN
SELECT pos, transcript_seconds(regexp_extract(stamp, '{_STAMP}', 1)), transcript_seconds(regexp_extract(stamp, '{_STAMP}', 2)), words FROM (
 SELECT pos, element_at(lines, at) AS stamp, array_join(filter(slice(lines, at + 1, size(lines)), x -> x <> ''), ' ') AS words FROM (
  SELECT pos, lines, CAST(array_position(transform(lines, x -> x RLIKE '{_STAMP}'), true) AS INT) AS at FROM (
   SELECT pos, transform(split(col, '\n'), x -> trim(x)) AS lines FROM posexplode(split(trim({_BODY}), '\n\\s*\n'))))
 WHERE at > 0) WHERE words <> ''"""


def _frames(f: pd.DataFrame):
    return (imaging.from_bytes(d, h, w) for h, w, d in zip(f["height"], f["width"], f["data"], strict=True))


def _regions(r) -> list[tuple[int, int, int, int]]:
    return [(x["x"], x["y"], x["w"], x["h"]) for x in (r if r is not None else [])]


@F.pandas_udf(T.StringType())
def _phash(f: pd.DataFrame, size: pd.Series) -> pd.Series:
    return pd.Series([imaging.phash(a, int(n)) for a, n in zip(_frames(f), size, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _phash_tiles(f: pd.DataFrame, size: pd.Series) -> pd.Series:
    return pd.Series([imaging.phash_tiles(a, a.shape[1], int(n)) for a, n in zip(_frames(f), size, strict=True)])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _channel_means(f: pd.DataFrame) -> pd.Series:
    return pd.Series([imaging.channel_means(a) for a in _frames(f)])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _block_means(f: pd.DataFrame, block: pd.Series) -> pd.Series:
    return pd.Series([imaging.block_means(a, int(n)).ravel() for a, n in zip(_frames(f), block, strict=True)])


@F.pandas_udf(T.DoubleType())
def _ssim(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    return pd.Series([imaging.ssim(imaging.gray(p), imaging.gray(q)) for p, q in zip(_frames(a), _frames(b), strict=True)], dtype=float)


@F.pandas_udf(REGIONS)
def _block_diff(a: pd.DataFrame, b: pd.DataFrame, block: pd.Series) -> pd.Series:
    found = [imaging.regions_of(imaging.block_diff(p, q, int(n)), int(n)) for p, q, n in zip(_frames(a), _frames(b), block, strict=True)]
    return pd.Series([[dict(zip("xywh", r, strict=True)) for r in regions] for regions in found])


@F.pandas_udf(FRAME)
def _mask_frame(f: pd.DataFrame, regions: pd.Series) -> pd.DataFrame:
    out = f.copy()
    out["data"] = [imaging.blank(a, _regions(r)).tobytes() for a, r in zip(_frames(f), regions, strict=True)]
    return out


@F.pandas_udf(pictures.DECODED)
def _decode_picture(data: pd.Series) -> pd.DataFrame:
    return pictures.decoded_rows(data)


ARROW = {"phash": _phash, "phash_tiles": _phash_tiles, "channel_means": _channel_means, "block_means": _block_means, "ssim": _ssim, "block_diff": _block_diff, "mask_frame": _mask_frame, "redact_frame": _mask_frame, "decode_picture": _decode_picture}


def register(spark: SparkSession, patterns: list[pii.Pattern] | None = None) -> list[str]:
    """Names of the functions that the session has then; find_pii, has_pii and redact_pii use the patterns, all built-ins by default."""
    chosen = list(pii.BUILTIN) if patterns is None else patterns
    for name, f in ARROW.items():
        spark.udf.register(name, f)
    spark.udf.register("find_pii", pii.spans_function(chosen))
    for name, parameters, kind, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    quoted = lambda p: "r'" + pii.java_regex(p).replace("'", "\\x27") + "'"
    regexes = [p for p in chosen if p.regex]
    redacted = "t"
    for p in regexes:
        redacted = f"regexp_replace({redacted}, {quoted(p)}, '[REDACTED]')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION redact_pii(t STRING) RETURNS STRING RETURN {redacted}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION has_pii(t STRING) RETURNS BOOLEAN RETURN {' OR '.join(f'coalesce(t, {chr(39) * 2}) RLIKE {quoted(p)}' for p in regexes) or 'false'}")
    spark.sql(TRANSCRIPT)
    return sorted([*ARROW, "find_pii", "redact_pii", "has_pii", "parse_transcript", *(n for n, *_ in EXPRESSIONS)])
