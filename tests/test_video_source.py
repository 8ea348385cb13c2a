"""Video files: metadata, sampling, ranges and how much is decoded for them."""

import numpy as np
import pytest
from framesift import cli
from framesift.config import Settings
from framesift.operators import pii, video
from framesift.sources import video_source as VS
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNull, LessThan
from test_video_cli import decoded, wav


def y4m(path, values, h=24, w=32, colour="mono", rate="30:1"):
    """Frames of one gray value each."""
    planes = {"mono": 0, "444": 2 * h * w, "420jpeg": 2 * (-(-h // 2)) * (-(-w // 2))}[colour]
    with open(path, "wb") as f:
        f.write(f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 C{colour}\n".encode())
        for v in values:
            f.write(b"FRAME\n" + bytes([v]) * (h * w) + bytes([128]) * planes)
    return str(path)


@pytest.fixture
def counted(monkeypatch):
    """Frames decoded in this process."""
    seen, plain = [], VS.Y4m._rgb
    monkeypatch.setattr(VS.Y4m, "_rgb", lambda self, data: seen.append(1) or plain(self, data))
    return seen


def test_metadata_reads_no_frame(spark, tmp_path):
    a, b = y4m(tmp_path / "a.y4m", [0] * 45), y4m(tmp_path / "b.Y4M", [1] * 10, 10, 20, "420jpeg", "25:2")
    got = {r.filename: r for r in VS.video_meta(spark, [a, b]).collect()}
    assert tuple(got["a.y4m"])[2:] == (1.5, 30.0, 32, 24, 45) and tuple(got["b.Y4M"])[2:] == (0.8, 12.5, 20, 10, 10)
    assert VS.listed(str(tmp_path)) == [a, b]


def test_only_what_is_asked_for_is_decoded(tmp_path, counted):
    y4m(tmp_path / "a.y4m", range(200))
    y4m(tmp_path / "b.y4m", range(100))
    read = lambda r: [(b["seq_id"][0].as_py(), b["seq_pos"][0].as_py(), b["frame"][0].as_py()["data"][0]) for p in r.partitions() for b in r.read(p)]
    sampled = read(VS.VideoReader({"path": str(tmp_path), "sampleFps": "1", "framesPerTask": "50"}))
    assert sampled == [("a.y4m", i, i) for i in range(0, 200, 30)] + [("b.y4m", i, i) for i in range(0, 100, 30)] and len(counted) == 11
    counted.clear()
    r = VS.VideoReader({"path": str(tmp_path), "framesPerTask": "50"})
    kept = list(r.pushFilters([EqualTo(("seq_id",), "a.y4m"), GreaterThanOrEqual(("seq_pos",), 70), LessThan(("seq_pos",), 130), IsNull(("frame",))]))
    assert kept == [IsNull(("frame",))] and [(p.start, p.end) for p in r.partitions()] == [(70, 100), (100, 130)]
    assert [x[1] for x in read(r)] == list(range(70, 130)) and len(counted) == 60
    r = VS.VideoReader({"path": str(tmp_path)})
    assert not list(r.pushFilters([In(("seq_id",), ("c.y4m",))])) and read(r) == []
    r = VS.VideoReader({"path": str(tmp_path)})
    assert not list(r.pushFilters([GreaterThanOrEqual(("seq_pos",), 500)])) and read(r) == []


def test_source_in_queries(spark, tmp_path):
    y4m(tmp_path / "a.y4m", range(120))
    y4m(tmp_path / "b.y4m", [7] * 20, 24, 32, "444")
    v = VS.read_videos(spark, [str(tmp_path)], frames_per_task=40)
    assert v.rdd.getNumPartitions() == 4 and v.groupBy("seq_id").count().orderBy("seq_id").collect() == [("a.y4m", 120), ("b.y4m", 20)]
    got = v.where("seq_id = 'a.y4m' and seq_pos between 35 and 44").orderBy("seq_pos").collect()
    assert [(r.seq_pos, r.frame.data[0]) for r in got] == [(i, i) for i in range(35, 45)] and got[0].total_frames == 120 and got[0].duration == 4.0
    plan = v.where("seq_pos >= 35")._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan  # taken over by the source
    half = VS.read_videos(spark, [str(tmp_path)], 2.0).groupBy("seq_id").agg(F.collect_list("seq_pos").alias("p")).orderBy("seq_id").collect()
    assert [sorted(r.p) for r in half] == [[0, 15, 30, 45, 60, 75, 90, 105], [0, 15]]


def test_gaps_are_decoded_where_they_lie(spark, tmp_path):
    p = y4m(tmp_path / "a.y4m", range(200))
    gaps = spark.createDataFrame([("a.y4m", 10, 14), ("a.y4m", 60, 61), ("a.y4m", 100, 103)], "seq_id string, prev_no long, frame_no long")
    assert sorted(r.seq_pos for r in VS.gap_frames(gaps, [p]).collect()) == [11, 12, 13, 101, 102]


def test_colours():
    v = VS.Y4m.__new__(VS.Y4m)
    v.meta, v.plane, v.marker = VS.Meta(30.0, 1.0, 2, 2), (1, 1), 6
    rgb = lambda y, u, w: v._rgb(b"FRAME\n" + bytes([y] * 4 + [u, w]))[0, 0].tolist()
    assert rgb(16, 128, 128) == [0, 0, 0] and rgb(235, 128, 128) == [255, 255, 255]
    assert rgb(81, 90, 240)[0] >= 253 and max(rgb(81, 90, 240)[1:]) <= 1  # red


def test_bad_videos(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        VS.listed(str(tmp_path / "none"))
    (tmp_path / "bad.y4m").write_bytes(b"no video at all\n")
    with pytest.raises(ValueError, match="Could not open video"):
        VS.open_video(str(tmp_path / "bad.y4m"))
    (tmp_path / "deep.y4m").write_bytes(b"YUV4MPEG2 W2 H2 F30:1 C420p10\n")
    with pytest.raises(ValueError, match="Could not open video"):
        VS.open_video(str(tmp_path / "deep.y4m"))
    with pytest.raises((ImportError, FileNotFoundError)):
        VS.open_video(str(tmp_path / "x.mp4"))


def test_files_give_what_a_table_gives(spark, tmp_path):
    s = Settings.of({"masking": {"block_size": 8}})
    values = {"a.y4m": [0] * 45 + [255] * 45, "b.y4m": [9] * 60, "c.y4m": [0] * 45 + [255] * 45 + [128] * 45}
    for n, v in values.items():
        y4m(tmp_path / n, v)
    table = None
    for n, v in values.items():
        d = decoded(spark, n, v)
        table = d if table is None else table.unionByName(d)
    rows = lambda df: sorted(map(repr, map(tuple, df.drop("frame").collect())))
    got = video.process_files(spark, [str(tmp_path)], s)
    assert rows(got) == rows(video.process(table, s))
    assert [r.video_frame_number for r in got.where("is_keyframe and source_video = 'c.y4m'").orderBy("seq_pos").collect()] == [0, 45, 90]


def test_command_line_with_files(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    y4m(src / "a.y4m", [0] * 45 + [255] * 45)
    assert cli.main(["--input", str(src), "--output", str(tmp_path / "out"), "--no-redact"]) == 0
    assert "Done: 2 total keyframes." in capsys.readouterr().out and sorted(p.name for p in (tmp_path / "out/a.y4m").iterdir()) == ["step_001.png", "step_002.png"]


@pytest.mark.parametrize(("srt", "want"), [("", ["silence", "speech"]), ("1\n00:00:00,000 --> 00:00:00,500\nhello\n", ["speech", "silence"])])
def test_speech_decides_where_a_transcript_has_no_cues(spark, tmp_path, srt, want):
    src = tmp_path / "in"
    src.mkdir()
    y4m(src / "a.y4m", [0] * 45 + [255] * 45)
    wav(src / "a.wav", [0, 1, 1])
    (tmp_path / "t.srt").write_text(srt)
    s = Settings.of({"masking": {"block_size": 8}, "exporter": {"output_dir": str(tmp_path / "out")}, "redactor": {"enabled": False}, "video": {"transcript_path": str(tmp_path / "t.srt")}})
    assert cli.run_videos(spark, src, s) == 2
    rows = spark.read.parquet(str(tmp_path / "out/manifest.parquet")).where("is_keyframe").orderBy("video_frame_number").collect()
    assert [r.audio_activity for r in rows] == want and rows[0].transcript_segment == (None if not srt else "hello")


def test_patterns_may_lack_a_regex(tmp_path):
    (tmp_path / "p.yaml").write_text("patterns:\n  - {name: ssn, enabled: false}\n  - {name: empty, more: 1}\n  - {name: id, regex: 'X[0-9]+'}\n")
    custom = pii.load_patterns(str(tmp_path / "p.yaml"))
    assert [p.name for p in pii.pattern_set(["email", "ssn", "id", "empty"], custom)] == ["email", "empty", "id"]
    (tmp_path / "none.yaml").write_text("patterns:\n")
    assert pii.load_patterns(str(tmp_path / "none.yaml")) == []
