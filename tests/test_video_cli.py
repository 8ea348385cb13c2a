import numpy as np
import pytest
from framesift import cli
from framesift.config import Settings
from framesift.functions import imaging
from framesift.operators import video
from framesift.schema import MANIFEST


def decoded(spark, name, values, fps=30.0):
    rows = [(name, i, fps, len(values) / fps, (24, 32, bytearray(np.full((24, 32, 3), v, np.uint8).tobytes()))) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq_id string, seq_pos long, fps double, duration double, frame struct<height:int,width:int,data:binary>")


def test_two_passes(spark):
    s = Settings.of({"masking": {"block_size": 8}, "redactor": {"enabled": False}})
    f = decoded(spark, "a.mp4", [0] * 45 + [255] * 45).unionByName(decoded(spark, "b.mp4", [9] * 60))
    seg = spark.createDataFrame([(0, 0.0, 0.5, "start"), (1, 1.4, 1.6, "turn")], "seg_pos int, start double, end double, text string")
    got = video.process(f, s, seg)
    assert got.columns == ["seq_id", "seq_pos", "frame", *[x.name for x in MANIFEST]]
    kf = {(r.source_video, r.frame_id): r for r in got.where("is_keyframe").collect()}
    assert set(kf) == {("a.mp4", "step_001"), ("a.mp4", "step_002"), ("b.mp4", "step_001")}
    turn = kf["a.mp4", "step_002"]
    assert turn.video_frame_number == 45 and turn.time_since_prev_keyframe == 1.5 and turn.total_keyframes == 2 and turn.transcript_segment == "turn" and turn.audio_activity == "speech"
    assert turn.prev_keyframe_id == "step_001" and turn.change_magnitude == "major" and turn.asset_path == "./output/a.mp4/step_002.png"
    assert got.where("source_video = 'a.mp4'").count() == 3 + 29


def test_one_transcript_for_all_videos(spark):
    """Joined by time alone; without cues, the speech of each video decides."""
    s = Settings.of({"masking": {"block_size": 8}, "redactor": {"enabled": False}})
    f = decoded(spark, "a.mp4", [0] * 45 + [255] * 45).unionByName(decoded(spark, "b.mp4", [9] * 60))
    seg = spark.createDataFrame([(0, 0.0, 0.5, "first"), (1, 0.0, 3.0, "both")], "seg_pos int, start double, end double, text string")
    speech = spark.createDataFrame([("a.mp4", 0, 1.4, 1.6, "[speech]")], "source_video string, seg_pos int, start double, end double, text string")
    for cues, texts, activity in (
        (seg, ["first | both", "both", "first | both"], ["speech", "speech", "speech"]),
        (seg.where("start = 1"), [None, None, None], ["silence", "speech", "silence"]),
    ):
        got = video.process(f, s, cues, speech)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan and got.columns == ["seq_id", "seq_pos", "frame", *[x.name for x in MANIFEST]]
        kf = sorted((r.source_video, r.frame_id, r.transcript_segment, r.audio_activity) for r in got.where("is_keyframe").collect())
        assert [k[:2] for k in kf] == [("a.mp4", "step_001"), ("a.mp4", "step_002"), ("b.mp4", "step_001")]
        assert [k[2] for k in kf] == texts and [k[3] for k in kf] == activity


def test_detect_mode(tmp_path):
    (tmp_path / "a.mp4").touch()
    assert cli.detect_mode(tmp_path, None, {".png"}) == "video" and cli.detect_mode(tmp_path / "a.mp4", "image", {".png"}) == "video"
    (tmp_path / "b.PNG").touch()
    with pytest.raises(SystemExit, match="--mode"):
        cli.detect_mode(tmp_path, None, {".png"})
    assert cli.detect_mode(tmp_path, "image", {".png"}) == "image"


def test_run_images(spark, tmp_path, capsys):
    src = tmp_path / "in"
    src.mkdir()
    for i, v in enumerate((0, 0, 150)):
        (src / f"frame_{i:03d}.png").write_bytes(imaging.png(np.full((100, 100, 3), v, np.uint8)))
    (src / "notes.txt").write_text("x")
    args = ["--input", str(src), "--output", str(tmp_path / "out"), "--no-redact", "--report", str(tmp_path / "r.html")]
    assert cli.main(args) == 0 and "Done: 2 keyframes from 3 frames (66.7%)" in capsys.readouterr().out
    assert sorted(p.name for p in (tmp_path / "out").glob("*.png")) == ["frame_000.png", "frame_002.png"]
    m = spark.read.parquet(str(tmp_path / "out" / "manifest.parquet"))
    assert m.count() == 3 and len(m.columns) == 30 and "2 keyframes of 3 frames" in (tmp_path / "r.html").read_text()


def wav(path, loud, rate=8000):
    """Seconds of silence or of a tone, by the flags."""
    import wave

    with wave.open(str(path), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        for flag in loud:
            w.writeframes((np.sin(np.arange(rate) / 3) * 20000 * flag).astype("<i2").tobytes())


def run_of_videos(spark, tmp_path, **kw):
    src = tmp_path / "in"
    src.mkdir(exist_ok=True)
    for name in ("a.mp4", "b.mp4"):
        (src / name).touch()
    wav(src / "a.wav", [0, 1, 1])
    s = Settings.of({"masking": {"block_size": 8}, "exporter": {"output_dir": str(tmp_path / "out")}} | kw)
    f = decoded(spark, "a.mp4", [0] * 45 + [255] * 45).unionByName(decoded(spark, "b.mp4", [9] * 60))

    def engine():
        return lambda a: [([[0, 0], [16, 0], [16, 24], [0, 24]], "mail a@b.example.com" if a.mean() > 100 else "nothing", 0.9)]

    n = cli.run_videos(spark, src, s, f, engine)
    return n, {(r.source_video, r.frame_id): r for r in spark.read.parquet(str(tmp_path / "out" / "manifest.parquet")).where("is_keyframe").collect()}


def test_keyframes_of_videos_are_redacted_and_speech_is_found(spark, tmp_path):
    from framesift.sources.images import load_frame

    n, kf = run_of_videos(spark, tmp_path, redactor={"scope": "full"})
    assert n == 3 and {k: r.pii_detected for k, r in kf.items()} == {("a.mp4", "step_001"): False, ("a.mp4", "step_002"): True, ("b.mp4", "step_001"): False}
    picture = load_frame(spark, tmp_path / "out" / "a.mp4" / "step_002.png")
    assert not picture[:, :16].any() and (picture[:, 16:] == 255).all()
    assert {k: r.audio_activity for k, r in kf.items()} == {("a.mp4", "step_001"): "silence", ("a.mp4", "step_002"): "speech", ("b.mp4", "step_001"): "silence"}


def test_keyframes_have_the_format_of_their_name(tmp_path):
    from framesift.sources.sinks import encoded

    a = np.zeros((8, 8, 3), np.uint8)
    assert encoded(a, "x/y.png")[:4] == b"\x89PNG" and encoded(a, "x/y.jpg")[:2] == b"\xff\xd8"
    with pytest.raises(ValueError, match="bmp"):
        encoded(a, "x/y.bmp")


@pytest.mark.parametrize(("h", "w"), [(1, 1), (8, 8), (7, 17), (64, 48), (120, 200)])
@pytest.mark.parametrize("kind", ["plain", "ramp", "noise", "text"])
def test_jpeg_is_read_by_others(spark, h, w, kind):
    """The JVM's reader finds the picture again, as closely as the quantisation lets it."""
    from framesift.functions.jpeg import jpeg
    from framesift.sources.images import load_frame

    rng = np.random.default_rng(h)
    a = np.full((h, w, 3), (200, 30, 90), np.uint8)
    if kind == "ramp":
        a[..., 0] = np.linspace(0, 255, w)[None, :]
        a[..., 1] = np.linspace(0, 255, h)[:, None]
    elif kind == "noise":
        a = rng.integers(0, 256, a.shape).astype(np.uint8)
    elif kind == "text":
        a[:] = 255
        a[rng.random((h, w)) < 0.1] = 0
    for quality, most in ((95, 12.0), (30, 70.0)):
        got = load_frame(spark, jpeg(a, quality)).astype(int)
        assert got.shape == a.shape and np.sqrt(((got - a) ** 2).mean()) < most
    assert kind == "noise" or h * w < 1000 or len(jpeg(a, 95)) < a.nbytes


def test_code_lengths_stay_short():
    from framesift.functions.jpeg import code_lengths

    for counts in ([1], [5, 5], [2**i for i in range(40)], np.random.default_rng(0).integers(0, 1000, 256), [1] * 256):
        n = code_lengths(np.array(counts))
        assert set(n) == {s for s, c in enumerate(counts) if c} and max(n.values()) <= 16 and sum(2.0**-x for x in n.values()) < 1


def test_pictures_with_odd_names_keep_their_order(spark, tmp_path):
    from framesift.sources.images import frames_from_dir

    for i, name in enumerate(["a b.png", "a%20c.png", "é.png", "z+1.PNG"]):
        (tmp_path / name).write_bytes(imaging.png(np.full((4, 4, 3), i, np.uint8)))
    got = sorted((r.seq_pos, r.frame_id, r.frame.data[0]) for r in frames_from_dir(spark, str(tmp_path)).collect())
    assert [g[0] for g in got] == [0, 1, 2, 3] and [g[1] for g in got] == sorted(g[1] for g in got) and sorted(g[2] for g in got) == [0, 1, 2, 3]


def test_backfill_over_many_buckets(spark):
    from framesift.operators import numbering

    frames = spark.range(3000).selectExpr("'v' as seq_id", "id as seq_pos")
    gaps = spark.createDataFrame([("v", 10, 900), ("v", 900, 901), ("v", 2000, 2002)], "seq_id string, prev_no long, frame_no long")
    got = sorted(r.seq_pos for r in numbering.backfill(frames, gaps, "seq_id", "seq_pos").collect())
    assert got == [*range(11, 900), 2001]
