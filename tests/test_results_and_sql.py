"""Metadata beside pictures, files against rows, documents of a run, text recognition at scale, and functions by name."""

import json

import numpy as np
from framesift import cli, sql
from framesift.functions import imaging
from framesift.operators import pii, results
from framesift.plans import virtual as V
from framesift.sources import images, media, sidecars
from pyspark.sql import functions as F
from test_cascade import solid

ROWS = "seq_id string, seq_pos long, frame_id string, is_keyframe boolean, asset_path string"


def test_sidecars(spark, tmp_path, capsys):
    for i, v in enumerate((10, 10, 220)):
        (tmp_path / f"f {i}.png").write_bytes(imaging.png(solid(v)))
    (tmp_path / "f 0.json").write_text('{\n "app_name": "editor",\n "timestamp": "2026-01-02T03:04:05Z"}')
    (tmp_path / "f 1.json").write_text("broken")
    (tmp_path / "x+y.json").write_text('{"app_name": 5}')
    s = {r.frame_id: r for r in sidecars.sidecars(spark, str(tmp_path)).collect()}
    assert set(s) == {"f 0", "f 1", "x+y"} and s["f 1"]._bad and s["f 0"]._bad is None and s["x+y"].app_name == "5"
    assert cli.main(["--input", str(tmp_path), "--output", str(tmp_path / "out"), "--no-redact"]) == 0
    m = spark.read.parquet(str(tmp_path / "out/manifest.parquet")).orderBy("frame_id").collect()
    assert [(r.app_name, r.timestamp is not None, r.source_format) for r in m] == [("editor", True, "png"), (None, False, "png"), (None, False, "png")]


def test_tasks(spark, tmp_path):
    for name, actions in (("a", 1), ("b", 5), ("c", None)):
        (tmp_path / name).mkdir()
        meta = {"website": f"{name}.example", "confirmed_task": "buy", "actions": [{"step_index": i, "operation": {"op": "CLICK", "n": i}} for i in range(actions)]} if actions else [1]
        (tmp_path / name / "metadata.json").write_text(json.dumps(meta))
    rows = spark.createDataFrame([(s, i * 10, "", True, None) for s in "abcd" for i in range(4)], ROWS)
    got = {(r.seq_id, r.seq_pos): r for r in sidecars.attach_tasks(rows, sidecars.tasks(spark, str(tmp_path))).collect()}
    step = lambda s, i: (a := got[s, i * 10].action) and json.loads(a.operation)["n"]
    assert [step("a", i) for i in range(4)] == [None, 0, None, None] and [step("b", i) for i in range(4)] == [None, 0, 1, 2] and len(got) == 16
    assert got["a", 0].app_name == "a.example" and got["d", 0].app_name == "" and got["d", 30].action is None


def test_files_against_rows(spark, tmp_path):
    for name in ("a.png", "sub dir/b+1.png", "c%20d.png", "left.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    paths = [f"{tmp_path}/a.png", f"file://{tmp_path}//sub dir/./b+1.png", f"file:{tmp_path}/c%20d.png", f"{tmp_path}/gone.png", None]
    rows = spark.createDataFrame([("s", i, str(i), p is not None, p) for i, p in enumerate(paths)], ROWS)
    files = sidecars.listing(spark, str(tmp_path))
    got = sidecars.with_files(rows, files).orderBy("seq_pos").collect()
    assert [(r.asset_path_exists, r.asset_path_bytes) for r in got] == [(True, 5), (True, 5), (True, 5), (False, None), (None, None)]
    assert [r.frame_id for r in sidecars.missing_files(rows, files).collect()] == ["3"] and [r.path for r in sidecars.unknown_files(files, rows).collect()] == [f"{tmp_path}/left.png"]
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan  # no content


def test_documents(spark, tmp_path):
    rows = [(s, i, f"f{i}", i % 3 == 0, None) for s in ("b", "a", None) for i in reversed(range(5))]
    df = spark.createDataFrame(rows, ROWS).withColumn("website", F.concat(F.lit("w"), "seq_id")).repartition(3)
    got = results.write_results(df, str(tmp_path))
    assert got["frames"] == 15 and got["keyframes"] == 6 and got["total_time_ms"] > 0
    total = json.loads(spark.read.text(f"{tmp_path}/summary").first().value)
    assert (total["total_frames"], total["total_keyframes"], total["total_skip_rate"], total["total_time_ms"]) == (15, 6, 0.6, got["total_time_ms"])
    assert [(t["task_id"], t["website"], t["num_keyframes"]) for t in total["tasks"]] == [(None, None, 2), ("a", "wa", 2), ("b", "wb", 2)]
    tasks = {d["task_id"]: d for d in (json.loads(r.value) for r in spark.read.text(f"{tmp_path}/results").collect())}
    assert [f["frame_id"] for f in tasks["a"]["frames"]] == [f"f{i}" for i in range(5)] and tasks[None]["num_frames"] == 5 and tasks["b"]["frames"][1] == {"frame_id": "f1", "is_keyframe": False, "asset_path": None}
    nothing = json.loads(results.summary_document(df.limit(0)).first().document)
    assert nothing == {"tasks": [], "total_frames": 0, "total_keyframes": 0, "total_skip_rate": 0.0} and results.task_documents(df.limit(0)).count() == 0


def engine_that_tells(folder):
    """Notes that it was made; reads the size and shade of what it is given."""

    def make():
        import uuid

        (folder / uuid.uuid4().hex).touch()
        return lambda a: [([[0, 0], [a.shape[1], 0], [a.shape[1], a.shape[0]], [0, a.shape[0]]], f"{a.shape[1]}x{a.shape[0]}:{a.mean():.0f}", 0.9), ([[0, 0], [1, 0], [1, 1], [0, 1]], "faint", 0.1)]

    return make


def test_engines_are_made_once_a_task(spark, tmp_path):
    rows = [(i, (20, 30, bytearray(solid(i, 20, 30).tobytes())), [(2, 3, 5, 4), (25, 15, 20, 20), (90, 90, 5, 5)] if i % 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, frame struct<height:int,width:int,data:binary>, regions array<struct<x:int,y:int,w:int,h:int>>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = pii.ocr_scan(df, ["id"], engine_that_tells(tmp_path), "regions").collect()
        made = len(list(tmp_path.iterdir()))
        kf = df.select("id", "frame", F.lit(True).alias("is_keyframe"), F.col("regions").alias("changed_regions"))
        redacted = pii.redact_keyframes(kf, [pii.Pattern("x", "5x4:")], engine_that_tells(tmp_path)).collect()
        assert len(list(tmp_path.iterdir())) - made <= 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 1 <= made <= 3
    want = sorted((i, t, b) for i in range(40) for t, b in ([(f"5x4:{i}", (2, 3, 5, 4)), (f"5x5:{i}", (25, 15, 5, 5))] if i % 2 else [(f"30x20:{i}", (0, 0, 30, 20))]))
    assert sorted((r.id, r.text, tuple(r.region)) for r in got) == want
    assert {r.id: r.pii_detected for r in redacted} == {i: i % 2 == 1 for i in range(40)}


def test_nested_directories(spark, tmp_path):
    for name in ("b/2.png", "b/1.png", "a/x/1.png", "top.png", "b/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(imaging.png(solid(len(name), 3, 3)) if name.endswith("png") else b"x")
    got = sorted((r.seq_id, r.seq_pos, r.frame_id, r.frame.data[0]) for r in images.frames_from_dir(spark, str(tmp_path), nested=True).collect())
    assert got == [("", 0, "top", 7), ("a/x", 0, "1", 9), ("b", 0, "1", 7), ("b", 1, "2", 7)]
    assert [r.frame_id for r in images.frames_from_dir(spark, str(tmp_path)).collect()] == ["top"]


TRANSCRIPTS = [
    "1\n00:00:01,000 --> 00:00:03,500\nHello world\n\n2\n00:00:05,000 --> 00:00:08,200\nClick\nthe  button \n", "", None, "no cues", "\r\n1\r\n01:02:03.004 --> 01:02:04,005 align:start\r\nWindows\r\n\r\n\r\n00:00:01,000-->00:00:02,000\nno number\n",
    "WEBVTT\nKind: captions\n\n00:00:01.000 --> 00:00:02.000\nA\n", "WEBVTT", "WEBVTT \n \n00:01.000 --> 00:02.000\nshort\n\n00:00:03.000 --> 00:00:04.000\n\n", "x\n\n\n00:00:03.000 --> 00:00:04.000\nlast",
]


def test_functions_by_name(spark):
    names = sql.register(spark)
    assert {"phash", "ssim", "block_diff", "mask_frame", "find_pii", "parse_transcript", "frame_hamming", "decode_picture"} <= set(names)
    t = spark.createDataFrame([(i, x, v) for i, x in enumerate(TRANSCRIPTS) for v in (False, True)], "id int, content string, is_vtt boolean")
    t.createOrReplaceTempView("t")
    got = spark.sql("SELECT id, is_vtt, c.* FROM t, LATERAL parse_transcript(t.content, t.is_vtt) AS c").collect()
    want = media.parse_transcripts(t, "content", F.col("is_vtt"), "id", "is_vtt").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) >= 10
    f = V.frames(spark, "/root/testdata/sf0.001")
    f.createOrReplaceTempView("f")
    r = spark.sql("SELECT channel_means(mask_frame(frame, array(named_struct('x', 0, 'y', 0, 'w', 8, 'h', 8))))[0] AS z, is_tall(frame.height, frame.width, 1.5D) AS tall, size(phash_tiles(frame, 2)) AS n, size(block_means(frame, 2)) AS m FROM f LIMIT 1").first()
    assert (r.z, r.tall, r.n, r.m) == (0.0, False, 1, 48)
    r = spark.sql("SELECT find_pii('x a@b.co 1.2.3.4') AS p, has_pii('none') AS a, has_pii(NULL) AS b, has_pii('a@b.co') AS c, redact_pii('to a@b.co') AS r").first()
    assert [(x.pattern, x.start, x.end) for x in r.p] == [("email", 2, 8), ("ip_address", 9, 16)] and (r.a, r.b, r.c, r.r) == (False, False, True, "to [REDACTED]")


def test_offsets_by_expressions_equal_those_of_python(spark):
    texts = ["", None, "a@b.co", "é 😀 a@b.co 555-123-4567 555-123-4567x 123-45-6789", "1.2.3.4 1.2.3.4.5 12 Main Street 4111 1111 1111 1111", "no", "@ @1"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    chosen = [*pii.BUILTIN, pii.Pattern("word", "[a-z]{2}"), pii.Pattern("none")]
    rows = df.select("id", pii.spans(F.col("t"), chosen).alias("a"), pii.spans_function(chosen)(F.col("t")).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(len(r.a) for r in rows) > 8
    assert np.all([len(r.a) == 0 for r in rows if not texts[r.id]])
