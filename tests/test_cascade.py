import json

import numpy as np
import pytest
from framesift.config import Settings, load_settings
from framesift.functions import imaging
from framesift.operators import cascade as K
from framesift.operators import numbering
from framesift.schema import MANIFEST
from framesift.streaming.keyframes import RunningMask


def solid(v, h=100, w=100):
    return np.full((h, w, 3), v, np.uint8)


def frames(spark, pictures, seq="s"):
    rows = [(seq, i, (a.shape[0], a.shape[1], bytearray(a.tobytes()))) for i, a in enumerate(pictures)]
    return spark.createDataFrame(rows, "seq_id string, seq_pos long, frame struct<height:int,width:int,data:binary>")


def manifest(spark, pictures, settings=None):
    return K.cascade(frames(spark, pictures), settings).orderBy("seq_pos").collect()


def tall(y, x, h, w):
    a = solid(220, 600, 200)
    a[y : y + h, x : x + w] = 10
    return a


def test_identical_frames(spark):
    r = manifest(spark, [solid(128)] * 3)
    assert [x.is_keyframe for x in r] == [True, False, False]
    assert r[0].visual_reason == K.FIRST and r[1].visual_reason == K.SAME and r[1].ssim_score is None
    assert r[1].prev_keyframe_id == "frame_000000" and r[0].prev_keyframe_id is None and r[1].asset_path is None


def test_big_change(spark):
    r = manifest(spark, [solid(50), solid(200), solid(200)])
    assert [x.is_keyframe for x in r] == [True, True, False] and r[1].ssim_score < 0.85
    assert r[1].visual_reason.startswith("Significant change — SSIM ") and r[1].prev_keyframe_path == "./output/frame_000000.png"
    assert r[2].prev_keyframe_id == "frame_000001"


def test_dimension_change(spark):
    r = manifest(spark, [solid(128, 64, 64), solid(128, 128, 128), solid(128, 64, 64)])
    assert all(x.is_keyframe for x in r) and r[1].visual_reason == "Dimension change (64x64 -> 128x128)"


def test_tiles_see_what_one_hash_does_not(spark):
    pictures = [solid(220, 600, 200), tall(280, 80, 30, 60)]
    assert [x.is_keyframe for x in manifest(spark, pictures)] == [True, True]
    assert [x.is_keyframe for x in manifest(spark, pictures, Settings.of({"hasher": {"tile_aspect_ratio": 100}}))] == [True, False]


def test_partitions_and_batches_make_no_difference(spark):
    rng = np.random.default_rng(3)
    pictures = [solid(int(v)) for v in rng.integers(0, 3, 40) * 90]
    f = frames(spark, pictures[:20], "a").unionByName(frames(spark, pictures[20:], "b"))
    want = None
    for n, batch in ((1, 1000), (7, 3)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = sorted(map(tuple, K.cascade(f.repartition(n)).select("seq_id", "seq_pos", "is_keyframe", "visual_reason").collect()))
        want = want or got
        assert got == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("window", "threshold"), [(15, 0.8), (1, 0.0), (5, 0.5), (15, 1.0)])
def test_mask_equals_the_running_one(spark, window, threshold):
    rng = np.random.default_rng(5)
    pictures = []
    for i in range(12):
        a = solid(128, 96, 64 if i < 8 else 96)
        a[:32, :32] = rng.integers(0, 256)
        if i % 2:
            a[32:64, 32:64] = rng.integers(0, 256)
        pictures.append(a)
    s = Settings.of({"masking": {"window_size": window, "noise_threshold": threshold}})
    got = K.with_masks(frames(spark, pictures), s).orderBy("seq_pos").collect()
    running = RunningMask(32, window, threshold)
    want = [running.step(a) for a in pictures]
    assert [[tuple(x) for x in r.adaptive_mask or []] for r in got] == want
    assert any(want) == (window > 1 and threshold < 1)


def test_manifest_schema(spark):
    df = K.to_manifest(K.cascade(frames(spark, [solid(1)])))
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in MANIFEST] and len(df.columns) == 30


def test_empty(spark):
    assert K.cascade(frames(spark, [solid(1)]).limit(0)).count() == 0


def test_sinks(spark, tmp_path):
    from framesift.sources import images, sinks

    s = Settings.of({"exporter": {"output_dir": str(tmp_path / "out")}})
    f = frames(spark, [solid(50), solid(50), solid(200)])
    c = K.cascade(f, s)
    assert sinks.write_manifest(c, str(tmp_path / "m"), "zstd") and not sinks.write_manifest(c.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    sinks.save_keyframes(f.join(c, ["seq_id", "seq_pos"])).collect()
    got = images.frames_from_dir(spark, str(tmp_path / "out")).orderBy("seq_pos").collect()
    assert [r.frame_id for r in got] == ["frame_000000", "frame_000002"] and got[1].frame.data == solid(200).tobytes() and got[0].source_format == "png"


def test_load_frame(spark, tmp_path):
    from framesift.sources.images import load_frame

    a = solid(7, 5, 6)
    (tmp_path / "a.png").write_bytes(imaging.png(a))
    (tmp_path / "bad.png").write_bytes(b"no picture")
    assert (load_frame(spark, tmp_path / "a.png") == a).all() and (load_frame(spark, imaging.png(a)) == a).all()
    with pytest.raises(FileNotFoundError):
        load_frame(spark, str(tmp_path / "none.png"))
    with pytest.raises(ValueError, match="Could not load image"):
        load_frame(spark, str(tmp_path / "bad.png"))
    with pytest.raises(TypeError, match="Unsupported source type"):
        load_frame(spark, 5)


def test_summary_of_nothing(spark):
    r = numbering.summary(spark.createDataFrame([], "is_keyframe boolean")).first()
    assert (r.num_frames, r.num_keyframes, r.skip_rate) == (0, 0, 0.0)


def test_settings(tmp_path):
    assert load_settings().comparator.ssim_threshold == 0.85
    (tmp_path / "a.json").write_text(json.dumps({"masking": {"block_size": 8}}))
    (tmp_path / "b.yaml").write_text("")
    assert load_settings(tmp_path / "a.json").masking.block_size == 8 and load_settings(tmp_path / "b.yaml") == Settings()
    for bad in ({"masking": {"block_size": 0}}, {"comparator": {"ssim_threshold": 2}}, {"video": {"sample_fps": 0}}, {"pipeline": {"mode": "x"}}, {"exporter": {"keyframe_format": "gif"}}):
        with pytest.raises(ValueError):
            Settings.of(bad)
    with pytest.raises(FileNotFoundError):
        load_settings(tmp_path / "none.yaml")
