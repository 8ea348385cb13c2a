"""Patterns of personal data on text and on frames."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import imaging
from ..schema import REGION
from .cascade import pixels_of


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str = ""
    description: str = ""
    enabled: bool = True


# The built-in patterns.
BUILTIN = (
    Pattern("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "addresses of mail"),
    Pattern("phone", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "numbers of three, three and four digits"),
    Pattern("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "numbers of three, two and four digits"),
    Pattern("credit_card", r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "four groups of four digits"),
    Pattern("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "dotted quads"),
    Pattern("address", r"\b\d{1,5}\s+\w+\s+(Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln)\b", "a number, a name and a kind of street"),
)
LEAST_CONFIDENCE = 0.3


def pattern_set(names: list[str], custom: list[Pattern] = ()) -> list[Pattern]:
    """Built-ins in order, replaced by customs of their name, without those that a custom disables; then only the names asked for."""
    found = {p.name: p for p in BUILTIN} | {p.name: p for p in custom}
    off = {p.name for p in custom if not p.enabled}
    return [p for p in found.values() if p.name in names and p.name not in off]


def load_patterns(path: str) -> list[Pattern]:
    """`patterns:` of a YAML file. One without a regex matches nothing, as for switching a built-in off; other keys are ignored."""
    import yaml

    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"no such file: {p}")
    known = Pattern.__dataclass_fields__
    return [Pattern(**{k: v for k, v in x.items() if k in known}) for x in (yaml.safe_load(p.read_text()) or {}).get("patterns") or []]


def java_regex(p: Pattern) -> str:
    return f"(?U){p.regex}"


def _may_match(text: Column, p: Pattern) -> Column | None:
    """A cheap test that holds for every text with a match of a built-in pattern: all need a digit, or the sign of an address."""
    if p.regex not in {b.regex for b in BUILTIN}:
        return None
    return F.contains(text, F.lit("@")) if "@" in p.regex else text.rlike(r"(?U)\d")


def matches(text: Column, p: Pattern) -> Column:
    """array<string> of a pattern's matches, on the JVM; classes and word bounds take all of Unicode."""
    none = F.array().cast("array<string>")
    if not p.regex:
        return none
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(java_regex(p)), F.lit(0))
    gate = _may_match(text, p)
    return found if gate is None else F.when(gate, found).otherwise(none)


def counts(df: DataFrame, text: str, patterns: list[Pattern]) -> DataFrame:
    """df with n_<name> for each pattern."""
    return df.withColumns({f"n_{p.name}": F.size(matches(F.col(text), p)) for p in patterns})


def found(df: DataFrame, text: str, patterns: list[Pattern], *keep: str) -> DataFrame:
    """(columns kept, pattern, matched) a row for each match."""

    def named(name: str):
        return lambda m: F.struct(F.lit(name).alias("pattern"), m.alias("matched"))

    one = [F.transform(matches(F.col(text), p), named(p.name)) for p in patterns if p.regex]
    return df.select(*keep, F.inline(F.concat(*one)))


SPANS = T.ArrayType(T.StructType([T.StructField("pattern", T.StringType()), T.StructField("matched", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def spans(text: Column, patterns: list[Pattern]) -> Column:
    """All matches with their offsets, pattern by pattern; overlaps of different patterns are kept. The pieces between matches give the offsets."""
    text = F.coalesce(text, F.lit(""))

    def of(p: Pattern) -> Column:
        parts = F.zip_with(F.split(text, java_regex(p), -1), matches(text, p), lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")))

        def add(acc, x):
            start = acc["at"] + F.length(x["piece"])
            end = start + F.length(x["match"])
            span = F.struct(F.lit(p.name).alias("pattern"), x["match"].alias("matched"), start.alias("start"), end.alias("end"))
            return F.when(x["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found")))

        none = F.array().cast(SPANS)
        found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("found")), add)["found"]
        gate = _may_match(text, p)
        return found if gate is None else F.when(gate, found).otherwise(none)

    return F.concat(F.array().cast(SPANS), *[of(p) for p in patterns if p.regex])


def spans_function(patterns: list[Pattern]):
    """The same as a function that can be registered, by Python's regular expressions."""
    compiled = [(p.name, re.compile(p.regex)) for p in patterns if p.regex]

    @F.pandas_udf(SPANS)
    def spans_(s: pd.Series) -> pd.Series:
        return pd.Series([[{"pattern": n, "matched": m[0], "start": m.start(), "end": m.end()} for n, r in compiled for m in r.finditer(t or "")] for t in s])

    return spans_


def has_pii(text: Column, patterns: list[Pattern]) -> Column:
    """Null without patterns."""
    text = F.coalesce(text, F.lit(""))
    gates = [(_may_match(text, p), text.rlike(java_regex(p))) for p in patterns if p.regex]
    tests = [test if gate is None else gate & test for gate, test in gates]
    out = tests[0] if tests else F.lit(None).cast("boolean")
    for t in tests[1:]:
        out = out | t
    return out


def redact_text(text: Column, patterns: list[Pattern], mark: str = "[REDACTED]") -> Column:
    out = text
    for p in patterns:
        if p.regex:
            out = F.regexp_replace(out, java_regex(p), mark)
    gates = [_may_match(text, p) for p in patterns if p.regex]
    if not gates or any(g is None for g in gates) or any(c.isdigit() or c == "@" for c in mark):
        return out
    return F.when(reduce(lambda a, b: a | b, gates), out).otherwise(text)  # most texts hold nothing that any pattern needs


Engine = Callable[[np.ndarray], list[tuple[list[list[float]], str, float]]]
_engines: dict[str, Engine] = {}


def easyocr_engine() -> Engine:
    """The reader of easyocr, made once in a worker; an ImportError where it isn't installed."""
    if "easyocr" not in _engines:
        import easyocr

        _engines["easyocr"] = easyocr.Reader(["en"]).readtext
    return _engines["easyocr"]


def read_text(frame: np.ndarray, engine: Engine, regions: list | None = None, least: float = LEAST_CONFIDENCE) -> list[tuple[str, tuple[int, int, int, int], float]]:
    """(text, region, confidence) in the whole frame, or in its regions with boxes moved to where the crop begins."""
    out = []
    for x, y, w, h in regions or [(0, 0, frame.shape[1], frame.shape[0])]:
        part = imaging.crop(frame, x, y, w, h)
        if not part.size:
            continue
        for quad, text, confidence in engine(part):
            if confidence >= least:
                xs, ys = [int(p[0]) for p in quad], [int(p[1]) for p in quad]
                out.append((text, (max(0, x) + min(xs), max(0, y) + min(ys), max(xs) - min(xs), max(ys) - min(ys)), float(confidence)))
    return out


def detect_and_redact(frame: np.ndarray, patterns: list[Pattern], engine: Engine, regions: list | None = None) -> tuple[np.ndarray, bool]:
    """The frame with every text box black in which a pattern matches, and whether there was one. No patterns: as it is."""
    if not patterns:
        return frame, False
    compiled = [re.compile(p.regex) for p in patterns if p.regex]
    hit = [box for text, box, _ in read_text(frame, engine, regions) if any(r.search(text) for r in compiled)]
    return (imaging.blank(frame, hit), True) if hit else (frame, False)


OCR_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("region", REGION), T.StructField("confidence", T.DoubleType())])


def ocr_scan(df: DataFrame, keep: list[str], make_engine: Callable[[], Engine] = easyocr_engine, regions: str | None = None, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(columns kept, text, region, confidence) of each text found in `frame`, or in the frame's regions, a column of that name, where it has any.

    A task makes one engine. Crops of a batch are read in the order of their size, so that an engine meets like ones together."""
    out = T.StructType([*(df.schema[c] for c in keep), *OCR_RESULT.fields])
    schema = to_arrow_schema(out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = None
        for b in it:
            engine = engine or make_engine()
            kept, inside = b.select(keep).to_pylist(), b[regions].to_pylist() if regions else [None] * b.num_rows
            frames = list(pixels_of(b))
            crops = [(i, r) for i, f in enumerate(frames) for r in ([tuple(x.values()) for x in inside[i] or []] or [(0, 0, f.shape[1], f.shape[0])])]
            rows = []
            for i, r in sorted(crops, key=lambda c: (c[1][3], c[1][2], c[0])):
                rows += [(i, kept[i] | {"text": t, "region": dict(zip("xywh", box, strict=True)), "confidence": c}) for t, box, c in read_text(frames[i], engine, [r], least)]
            if rows:
                yield pa.RecordBatch.from_pylist([r for _, r in sorted(rows, key=lambda r: r[0])], schema)

    columns = [*keep, "frame", *([regions] if regions and regions not in keep else [])]
    return df.select(*columns).mapInArrow(run, out)


def redact_keyframes(df: DataFrame, patterns: list[Pattern], make_engine: Callable[[], Engine] = easyocr_engine, scope: str = "changed") -> DataFrame:
    """df (frame, is_keyframe, changed_regions, ..) with frame redacted and pii_detected on keyframes; other rows pass without OCR.

    scope changed: only changed regions are read, where there are any; full: always the whole frame."""
    if not patterns:
        return df.withColumn("pii_detected", F.lit(None).cast("boolean"))
    out_type = T.StructType([df.schema["frame"], T.StructField("pii_detected", T.BooleanType())])

    @F.pandas_udf(out_type)
    def run(it: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        engine = None  # one for each task that has frames
        for f, regions in it:
            frames, flags = [], []
            for h, w, d, r in zip(f["height"], f["width"], f["data"], regions, strict=True):
                engine = engine or make_engine()
                inside = [(x["x"], x["y"], x["w"], x["h"]) for x in r] if scope == "changed" and r is not None else None
                a, hit = detect_and_redact(imaging.from_bytes(d, h, w), patterns, engine, inside)
                frames.append({"height": h, "width": w, "data": a.tobytes()})
                flags.append(hit)
            yield pd.DataFrame({"frame": pd.Series(frames, dtype=object), "pii_detected": pd.Series(flags, dtype=object)})

    kf = df.where("is_keyframe").withColumn("_r", run(F.col("frame"), F.col("changed_regions"))).withColumn("frame", F.col("_r.frame")).withColumn("pii_detected", F.col("_r.pii_detected")).drop("_r")
    return kf.unionByName(df.where("not is_keyframe").withColumn("pii_detected", F.lit(None).cast("boolean")))
