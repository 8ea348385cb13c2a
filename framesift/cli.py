"""Command line: pictures, decoded video or messages of a directory to keyframes and a manifest."""

from __future__ import annotations

import argparse
import dataclasses as dc
from pathlib import Path

from .config import Settings, load_settings

VERSION = "0.1.0"
VIDEO = {".mp4", ".mov", ".webm", ".y4m"}


def detect_mode(path: Path, mode: str | None, pictures: set[str]) -> str:
    """A file: by its suffix. A directory: the mode asked for; else by what it holds, an error for both kinds."""
    if path.is_file():
        return "video" if path.suffix.lower() in VIDEO else "image"
    if mode:
        return mode
    kinds = {f.suffix.lower() for f in path.iterdir() if f.is_file()}
    if kinds & VIDEO and kinds & pictures:
        raise SystemExit(f"{path} holds pictures and videos; choose with --mode")
    return "video" if kinds & VIDEO else "image"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="framesift")
    p.add_argument("--input", required=True, type=Path)
    p.add_argument("--output", default=None)
    p.add_argument("--config", default=None)
    p.add_argument("--mode", choices=["image", "video", "stream"])
    p.add_argument("--transcript")
    p.add_argument("--report", help="write an HTML page here")
    p.add_argument("--no-redact", action="store_true")
    p.add_argument("--no-audio", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    return p


def settings_of(args: argparse.Namespace) -> Settings:
    s = load_settings(args.config)
    if args.output:
        s.exporter.output_dir = args.output
    if args.no_redact:
        s.redactor.enabled = False
    if args.no_audio:
        s.video.audio_detection = False
    if args.transcript:
        s.video.transcript_path = args.transcript
    if args.mode == "stream":
        s.pipeline.mode = "stream"
    return dc.replace(s)


def patterns_of(s: Settings):
    from .operators import pii

    file = s.redactor.custom_patterns_file
    return pii.pattern_set(s.redactor.pii_types, pii.load_patterns(file) if file and Path(file).exists() else [])


def run_images(spark, path: Path, s: Settings, report: str | None = None) -> tuple[int, int]:
    """Writes pictures and manifest; keyframes and frames."""
    from .operators import cascade, numbering, pii
    from .shared import cut
    from .sources import images, sidecars, sinks

    frames = pictures = images.frames_from_dir(spark, str(path), s.input.supported_formats)
    if any(path.glob("*.json")):
        frames = sidecars.attach_sidecars(frames, sidecars.sidecars(spark, str(path)))
    rows = cut(cascade.cascade(frames, s), "rows")  # without pixels
    kept = rows.where("is_keyframe").join(pictures.select("seq_id", "seq_pos", "frame"), ["seq_id", "seq_pos"])
    if s.redactor.enabled:
        kept = cut(pii.redact_keyframes(kept.drop("pii_detected"), patterns_of(s), scope=s.redactor.scope), "keyframes")
        flags = kept.select("seq_id", "seq_pos", "pii_detected")
        rows = rows.drop("pii_detected").join(flags, ["seq_id", "seq_pos"], "left")
    out = s.exporter.output_dir.rstrip("/")
    sinks.save_keyframes(kept).count()
    sinks.write_manifest(rows.orderBy("seq_id", "seq_pos"), f"{out}/manifest.parquet", s.exporter.parquet_compression)
    if report:
        from .report import render

        Path(report).write_text(render(rows))
    total = numbering.summary(rows).first()
    return total.num_keyframes, total.num_frames


def speech_of(spark, files: list[Path]):
    """Speech in the sound of videos, from WAV files beside them that have their names; None where there are none."""
    from pyspark.sql import functions as F

    from .operators import align
    from .sources import media

    beside = {f.with_suffix(".wav"): f.name for f in files if f.with_suffix(".wav").exists()}
    if not beside:
        return None
    chunks = media.sound_chunks(spark, [str(p) for p in beside])
    names = spark.createDataFrame([(p.name, name) for p, name in beside.items()], "_wav string, source_video string")  # a row a file
    chunks = chunks.withColumn("_wav", F.element_at(F.split("source", "/"), -1)).join(F.broadcast(names), "_wav").drop("source", "_wav")
    return align.speech_segments(chunks, "source_video")


def run_videos(spark, path: Path, s: Settings, frames=None, make_engine=None) -> int:
    """Keyframes of all videos, each numbered by itself; pictures go to a folder of the video's name, redacted unless that is switched off.

    frames: decoded frames, if they don't come from the files; make_engine: text recognition other than easyocr's."""
    from pyspark.sql import functions as F

    from .operators import pii, video
    from .shared import cut
    from .sources import media, sinks

    files = [path] if path.is_file() else sorted(f for f in path.iterdir() if f.suffix.lower() in VIDEO)
    segments = media.transcripts(spark, s.video.transcript_path) if s.video.transcript_path else None
    speech = speech_of(spark, files) if s.video.audio_detection else None  # decides where the transcript has no cues
    if frames is None:
        rows = video.process_files(spark, [str(f) for f in files], s, segments, speech)
    else:
        rows = video.process(frames, s, segments, speech)
    if s.redactor.enabled:
        rows = pii.redact_keyframes(rows.drop("pii_detected"), patterns_of(s), make_engine or pii.easyocr_engine, scope=s.redactor.scope)
    rows = cut(rows.withColumn("frame", F.when(F.col("is_keyframe"), F.col("frame"))), "rows")
    sinks.save_keyframes(rows).count()
    sinks.write_manifest(rows, f"{s.exporter.output_dir.rstrip('/')}/manifest.parquet", s.exporter.parquet_compression)
    return rows.where("is_keyframe").count()


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    args = parser().parse_args(argv)
    if not args.input.exists():
        raise SystemExit(f"no such path: {args.input}")
    s = settings_of(args)
    if s.pipeline.mode == "stream":
        from .streaming import sink

        spark = SparkSession.builder.appName("framesift").getOrCreate()
        kept, n = sink.run_stream(spark, str(args.input), s, patterns_of(s) if s.redactor.enabled else [])
        print(f"Done: {kept} keyframes from {n} frames.")
        return 0
    mode = detect_mode(args.input, args.mode, {f".{x}" for x in s.input.supported_formats})
    spark = SparkSession.builder.appName("framesift").getOrCreate()
    if mode == "video":
        print(f"Done: {run_videos(spark, args.input, s)} total keyframes.")
        return 0
    if not any(f.suffix.lower().lstrip(".") in s.input.supported_formats for f in args.input.iterdir()):
        print(f"No supported images found in {args.input}")
        return 0
    kept, n = run_images(spark, args.input, s, args.report)
    print(f"Done: {kept} keyframes from {n} frames ({100 * kept / n:.1f}%).")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
