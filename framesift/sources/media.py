"""Transcripts, sound and pre-decoded video."""

from __future__ import annotations

import io
import math
import wave

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIME = "(\\d{2}:\\d{2}:\\d{2}[.,]\\d{3})\\s*-->\\s*(\\d{2}:\\d{2}:\\d{2}[.,]\\d{3})"


def seconds(t: Column) -> Column:
    """HH:MM:SS,mmm or HH:MM:SS.mmm."""
    p = F.split(F.replace(t, F.lit(","), F.lit(".")), ":")
    return p[0].cast("int") * 3600 + p[1].cast("int") * 60 + p[2].cast("double")


def without_vtt_header(text: Column) -> Column:
    """What follows the first blank line of a text that starts with WEBVTT; without a blank line there are no cues."""
    first = F.trim(F.split(text, "\n", 2)[0])
    return F.when(~first.startswith("WEBVTT"), text).otherwise(F.regexp_extract(text, "(?s)\\A.*?\\n[ \\t]*\\n(.*)\\z", 1))


def parse_transcripts(df: DataFrame, text: str, is_vtt: Column, *keep: str) -> DataFrame:
    """(columns kept, seg_pos, start, end, text) of every cue that has a time line and words."""
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n"))
    body = F.when(is_vtt, without_vtt_header(body)).otherwise(body)
    blocks = df.select(*keep, F.posexplode(F.split(F.trim(body), "\n\\s*\n")).alias("_n", "_block"))
    lines = F.transform(F.split("_block", "\n"), lambda x: F.trim(x))
    timed = F.transform(lines, lambda x: x.rlike(TIME))
    blocks = blocks.withColumn("_l", lines).withColumn("_at", F.array_position(timed, True)).where("_at > 0")
    stamp = F.element_at("_l", F.col("_at").cast("int"))
    words = F.array_join(F.filter(F.slice("_l", F.col("_at").cast("int") + 1, F.size("_l")), lambda x: x != ""), " ")
    cues = blocks.select(*keep, "_n", seconds(F.regexp_extract(stamp, TIME, 1)).alias("start"), seconds(F.regexp_extract(stamp, TIME, 2)).alias("end"), words.alias("text")).where("text <> ''")
    return cues.withColumnRenamed("_n", "seg_pos")


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Cues of transcript files: .vtt files are WebVTT, all others SRT."""
    files = spark.read.text(path, wholetext=True).withColumn("source", F.col("_metadata.file_path"))
    return parse_transcripts(files, "value", F.lower("source").endswith(".vtt"), "source")


def dbfs(samples: np.ndarray, width: int) -> float:
    """Loudness against full scale; silence is minus infinity."""
    rms = math.sqrt(float((samples.astype(np.float64) ** 2).mean())) if len(samples) else 0.0
    return 20 * math.log10(rms / (1 << (8 * width - 1))) if rms else -math.inf


def sound_chunks(spark: SparkSession, path: str | list[str], chunk_s: float = 0.5) -> DataFrame:
    """(source, chunk, dbfs, duration) of WAV files."""

    def run(it):
        for pdf in it:
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    width, rate, channels, n = w.getsampwidth(), w.getframerate(), w.getnchannels(), w.getnframes()
                    raw = np.frombuffer(w.readframes(n), {1: np.uint8, 2: "<i2", 4: "<i4"}[width])
                raw = raw.astype(np.int64) - (128 if width == 1 else 0)
                step = int(rate * chunk_s) * channels
                rows = [(source, i, dbfs(raw[a : a + step], width), n / rate) for i, a in enumerate(range(0, len(raw), step))]
                yield pd.DataFrame(rows, columns=["source", "chunk", "dbfs", "duration"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source string, chunk long, dbfs double, duration double")
