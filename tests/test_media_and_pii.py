import math
import random
import wave
from collections import defaultdict

import numpy as np
import pytest
from framesift.operators import align, pii
from framesift.sources import media
from pyspark.sql import functions as F

SRT = "1\n00:00:01,000 --> 00:00:03,500\nHello world\n\n2\n00:00:05.000 --> 00:00:08.200\n Click the \nbutton\n\n3\nno time\nwords\n\n4\n00:00:09,000 --> 00:00:10,000\n\n"


def cues(spark, text, vtt=False):
    df = spark.createDataFrame([(text,)], "t string")
    return [tuple(r) for r in media.parse_transcripts(df, "t", F.lit(vtt)).select("start", "end", "text").orderBy("start").collect()]


def test_transcripts(spark):
    want = [(1.0, 3.5, "Hello world"), (5.0, 8.2, "Click the button")]
    assert cues(spark, SRT) == want and cues(spark, "") == [] and cues(spark, None) == []
    assert cues(spark, "WEBVTT\nKind: captions\n\n" + SRT, True) == want and cues(spark, SRT, True) == want
    assert cues(spark, "WEBVTT\n" + SRT.split("\n\n")[0], True) == []
    assert cues(spark, "00:05.000 --> 00:06.000\nshort stamps don't count") == []


def test_alignment(spark):
    seg = spark.createDataFrame([("v", 0, 0.0, 5.0, "First part"), ("v", 1, 4.0, 8.0, "Second part"), ("v", 2, 100.0, 300.0, "Long")], "v string, seg_pos int, start double, end double, text string")
    pts = spark.createDataFrame([(i, "v", t) for i, t in enumerate((4.5, 5.0, 8.0, 9.0, 250.0))], "id int, v string, t double")
    got = {r.id: r.transcript_segment for r in align.align_transcript(pts, seg, "v", "t", ["id"]).collect()}
    assert got == {0: "First part | Second part", 1: "First part | Second part", 2: "Second part", 3: None, 4: "Long"}
    assert {r.id for r in align.has_speech(pts, seg, "v", "t", ["id"]).where("in_speech").collect()} == {0, 1, 2, 4}


def test_audio_precedence(spark):
    df = spark.createDataFrame([(True, "x", True), (True, None, True), (True, "", False), (False, "x", True)], "k boolean, t string, s boolean")
    k, t, s = F.col("k"), F.col("t"), F.col("s")
    got = df.select(align.audio_activity(k, t, s).alias("a"), align.audio_activity(k, None, s).alias("b"), align.audio_activity(k, None, None).alias("c"), align.audio_activity(k, None, None, False).alias("d")).collect()
    assert [tuple(r) for r in got] == [("speech", "speech", "silence", None), ("silence", "speech", "silence", None), ("silence", "silence", "silence", None), (None, None, None, None)]


def test_speech(spark, tmp_path):
    rate = 8000
    tone = (np.sin(np.arange(rate) * 440 * 2 * np.pi / rate) * 10 ** (-10 / 20) * 32767).astype("<i2")
    for name, parts in (("a", [np.zeros(rate, "<i2"), tone, np.zeros(rate, "<i2")]), ("b", [np.zeros(2 * rate, "<i2")]), ("c", [np.zeros(rate, "<i2"), tone[: rate * 3 // 4]])):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.concatenate(parts).tobytes())
    got = align.speech_segments(media.sound_chunks(spark, str(tmp_path)), "source").collect()
    assert {(r.source[-5], r.start, r.end) for r in got} == {("a", 1.0, 2.0), ("c", 1.0, 1.75)}
    assert media.dbfs(np.zeros(4), 2) == -math.inf


TEXTS = {
    "email": "john@example.com", "phone": "call 555-123-4567", "ssn": "123-45-6789", "credit_card": "4111 1111 1111 1111", "ip_address": "at 192.168.1.100", "address": "123 Main Street", None: "nothing here",
}


def test_patterns(spark):
    df = spark.createDataFrame([(k or "", v) for k, v in TEXTS.items()] + [("", None)], "k string, t string")
    all_ = pii.pattern_set([p.name for p in pii.BUILTIN])
    got = df.select("k", pii.has_pii(F.col("t"), all_).alias("hit"), pii.spans(F.col("t"), all_).alias("s"), pii.redact_text(F.col("t"), all_).alias("r")).collect()
    for r in got:
        assert r.hit == bool(r.k) and (r.k in {s.pattern for s in r.s}) == bool(r.k) and ("[REDACTED]" in (r.r or "")) == bool(r.k)


def test_pattern_set():
    custom = [pii.Pattern("email", "x+"), pii.Pattern("ssn", "y", enabled=False), pii.Pattern("new", "z")]
    assert [(p.name, p.regex) for p in pii.pattern_set(["email", "ssn", "phone"], custom)] == [("email", "x+"), ("phone", pii.BUILTIN[1].regex)]
    assert [p.name for p in pii.pattern_set(["new"], custom)] == ["new"] and pii.pattern_set([]) == []


def test_frames():
    a = np.full((100, 100, 3), 9, np.uint8)
    engine = lambda part: [([[10, 20], [90, 20], [90, 40], [10, 40]], "mail j@x.com", 0.9), ([[0, 0], [5, 0], [5, 5], [0, 5]], "j@x.com", 0.1)]
    pats = pii.pattern_set(["email"])
    out, hit = pii.detect_and_redact(a, pats, engine)
    assert hit and out[20:40, 10:90].sum() == 0 and out[:20].all() and a.all()
    assert pii.read_text(a, engine, [(50, 80, 40, 10), (200, 200, 5, 5)]) == [("mail j@x.com", (60, 100, 80, 20), 0.9)]
    assert pii.detect_and_redact(a, [], engine)[1] is False
    assert pii.detect_and_redact(a, pii.pattern_set(["ssn"]), engine)[1] is False
    with pytest.raises(ImportError):
        pii.easyocr_engine()


def _shuffled(df):
    """Bytes that the exchanges of df wrote, in Spark's rows."""
    df.collect()

    def of(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return of(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return of(node.plan())
        own = node.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(of(node.children().apply(i)) for i in range(node.children().size()))

    return of(df._jdf.queryExecution().executedPlan())


def test_texts_are_not_shuffled_for_each_point(spark):
    """Points times segments of one moment, and segments that touch many minutes."""
    pts = spark.range(300).selectExpr("id", "'v' AS v", "100.0D AS t").repartition(4)
    seg = spark.range(300).selectExpr("'v' AS v", "id AS seg_pos", "90.0D AS start", "110.0D AS end", "concat('text', id) AS text").repartition(4)
    got = align.align_transcript(pts, seg, "v", "t", ["id"])
    assert {r.transcript_segment for r in got.collect()} == {" | ".join(f"text{i}" for i in range(300))} and got.count() == 300
    assert _shuffled(align.align_transcript(pts, seg, "v", "t", ["id"])) < 300_000  # 90 000 pairs
    long = seg.withColumn("end", F.lit(1e6))
    assert _shuffled(align.align_transcript(pts, long, "v", "t", ["id"])) < 300_000
    assert _shuffled(align.has_speech(pts, long, "v", "t", ["id"])) < 300_000


def test_alignment_of_odd_rows(spark):
    """Repeated and null ids, keys and times, segments of any length, backwards ones among them, against a plain version."""
    rng = random.Random(3)
    pick = lambda *a: rng.choice(a)
    pts = [(pick(None, *range(150)), pick(None, "a", "b", "c"), pick(None, rng.uniform(-500, 5000), float(rng.randrange(0, 4000, 60)))) for _ in range(300)]
    seg = []
    for i in range(80):
        at = float(rng.randrange(-200, 4000, 20))
        seg.append((pick(None, "a", "b"), pick(i, 7), pick(None, at), at + pick(0.0, 0.5, 60.0, 3600.0, 90000.0, -5.0), pick(None, "", f"w{i}", f"w{i}")))
    p, s = spark.createDataFrame(pts, "id int, v string, t double").repartition(3), spark.createDataFrame(seg, "v string, seg_pos int, start double, end double, text string").repartition(2)
    held = defaultdict(list)
    for i, v, t in pts:
        for k, pos, lo, hi, w in seg:
            if i is not None and None not in (v, t, lo) and k == v and lo <= t <= hi:
                held[i].append((pos, w is not None, w or "", w))
    want = sorted(repr((i, v, t, " | ".join(x[3] for x in sorted(held[i], key=lambda x: x[:3]) if x[1]) if i in held else None)) for i, v, t in pts)
    assert sorted(repr(tuple(r)) for r in align.align_transcript(p, s, "v", "t", ["id"]).select("id", "v", "t", "transcript_segment").collect()) == want
    assert sorted(repr(tuple(r)) for r in align.has_speech(p, s, "v", "t", ["id"]).select("id", "in_speech").collect()) == sorted(repr((i, i in held)) for i, _, _ in pts)
    assert all(r.transcript_segment is None for r in align.align_transcript(p, s.limit(0), "v", "t", ["id"]).collect())
