"""Frames as messages: micro-batches, restarts and late frames against the batch query."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest
from framesift import cli
from framesift.config import Settings
from framesift.functions import imaging, pictures
from framesift.operators import cascade as K
from framesift.operators import pii
from framesift.streaming import messages
from framesift.streaming.sink import LATE, ManifestSink, run_stream, start
from pyspark.sql import functions as F
from test_cascade import frames, solid
from test_split_fold import restless

SETTINGS = {"masking": {"block_size": 8, "window_size": 5, "noise_threshold": 0.6}, "hasher": {"hash_size": 4}, "comparator": {"min_changed_blocks": 2}}


def message(seq, pos, a, **more):
    return json.dumps({"sequence": seq, "position": pos, "image": base64.b64encode(imaging.png(a)).decode()} | more)


def put(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(lines))


def settings(tmp_path, **exporter):
    return Settings.of(SETTINGS | {"exporter": {"output_dir": str(tmp_path / "out")} | exporter, "redactor": {"enabled": False}})


COLUMNS = ["seq_pos", "is_keyframe", "visual_reason", "perceptual_hash", "ssim_score", "changed_regions", "adaptive_mask", "frame_width", "prev_keyframe_id", "event_type"]


def test_three_batches_and_a_restart_equal_the_batch_query(spark, tmp_path):
    s, rng = settings(tmp_path), np.random.default_rng(4)
    sequences = {"a": restless(45, rng), "b": restless(30, rng)}
    everything = [(q, i, a) for q, p in sequences.items() for i, a in enumerate(p)]
    for n in range(3):  # a run each: the second and third begin from the checkpoint
        mine = [m for m in everything if m[1] * 3 // len(sequences[m[0]]) == n]
        rng.shuffle(mine)
        put(tmp_path / "in", f"f{n}", [message(*m, app_name="editor") for m in mine])
        run_stream(spark, str(tmp_path / "in"), s)
    got = spark.read.parquet(str(tmp_path / "out/manifest"))
    assert sorted(r.batch_id for r in got.select("batch_id").distinct().collect())[-1] >= 2
    for q, p in sequences.items():
        want = K.cascade(frames(spark, p, q), s).select(*COLUMNS).orderBy("seq_pos").collect()
        mine = got.where(F.col("seq_id") == q).orderBy("seq_pos")
        assert mine.select(*COLUMNS).collect() == want
        kf = [r for r in mine.collect() if r.is_keyframe]
        assert [r.keyframe_index for r in kf] == list(range(1, len(kf) + 1)) and {r.total_keyframes for r in kf} == {len(kf)} and {r.app_name for r in kf} == {"editor"}
        for r in kf:
            name = r.asset_path
            assert (pictures.decode(open(name, "rb").read()) == p[r.seq_pos]).all()
    assert not list((tmp_path / "out/_staged").iterdir())


def test_late_and_repeated_frames_are_flagged(spark, tmp_path):
    s = settings(tmp_path)
    put(tmp_path / "in", "1", [message("a", i, solid(20, 32, 32)) for i in (2, 0, 1)] + [message("a", 6, solid(200, 32, 32))])
    run_stream(spark, str(tmp_path / "in"), s)
    put(tmp_path / "in", "2", [message("a", 5, solid(90, 32, 32)), message("a", 6, solid(90, 32, 32)), message("a", 7, solid(200, 32, 32))])
    assert run_stream(spark, str(tmp_path / "in"), s) == (2, 7)
    rows = spark.read.parquet(str(tmp_path / "out/manifest")).orderBy("batch_id", "seq_pos", "late").collect()
    assert [(r.seq_pos, r.late, r.is_keyframe) for r in rows] == [(0, False, True), (1, False, False), (2, False, False), (6, False, True), (5, True, False), (6, True, False), (7, False, False)]
    assert rows[4].visual_reason == LATE and rows[4].perceptual_hash is None and rows[6].prev_keyframe_id == "frame_000006"


def test_bad_messages_are_kept_aside(spark, tmp_path):
    good = message("a", 1, solid(20, 32, 32))
    lines = ["not json", "", "{}", '{"sequence": "a", "position": 0}', '{"sequence": "a", "image": "aGVsbG8="}', '{"position": 4, "image": "%%%"}', message("a", 0, solid(7, 8, 8)).replace("iVBOR", "iVBOS"), good, '{"unknown": 1}']
    put(tmp_path / "in", "1", lines)
    assert run_stream(spark, str(tmp_path / "in"), settings(tmp_path)) == (1, 1)
    bad = [(r.seq_pos, r.bad) for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()]
    reasons = [b for _, b in bad]
    assert len(bad) == len(lines) - 1 - reasons.count("") and reasons.count(messages.NOT_JSON) == 4 and reasons.count(messages.NO_IMAGE) == 2 and reasons.count(messages.NO_PLACE) == 1
    assert [p for p, b in bad if b.startswith("Could not load image")] == [0]


def test_a_batch_run_twice_leaves_the_same_rows(spark, tmp_path):
    s = settings(tmp_path)
    put(tmp_path / "in", "1", [message("a", i, solid(20 + 90 * (i % 3), 32, 32)) for i in range(6)])
    put(tmp_path / "in", "2", [message(q, i, solid(30, 32, 32)) for q in "ab" for i in range(6, 9)])
    kept = []

    class Twice(ManifestSink):
        def __call__(self, batch, batch_id):
            super().__call__(batch, batch_id)
            if batch_id == 0:
                self.finish(batch.sparkSession)
            again = self._table(batch.sparkSession, "log").where(F.col("batch_id") == batch_id)
            kept.append(sorted(map(repr, again.collect())))
            super().__call__(batch, batch_id)
            assert sorted(map(repr, self._table(batch.sparkSession, "log").where(F.col("batch_id") == batch_id).collect())) == kept[-1]

    sink = Twice(s)
    start(messages.read_lines(spark, str(tmp_path / "in"), 1), sink, str(tmp_path / "cp")).awaitTermination()
    assert [len(k) for k in kept if k] == [6, 6]  # a last batch, for timers, may be empty
    assert len(sink.finish(spark)) in (1, 2) and sink.finish(spark) == []
    assert spark.read.parquet(str(tmp_path / "out/manifest")).count() == 12


def test_only_touched_sequences_are_written_anew(spark, tmp_path):
    s, seen = settings(tmp_path), []
    for n, names in enumerate(["abcdef", "c"]):
        put(tmp_path / "in", str(n), [message(q, n, solid(30 + 100 * n, 32, 32)) for q in names])
        sink = ManifestSink(s)
        start(messages.read_lines(spark, str(tmp_path / "in")), sink, str(tmp_path / "cp")).awaitTermination()
        seen.append(sink.finish(spark))
    assert len(seen[0]) > 1 and len(seen[1]) == 1
    got = {r.seq_id: r.total_keyframes for r in spark.read.parquet(str(tmp_path / "out/manifest")).where("is_keyframe").collect()}
    assert got == {q: 2 if q == "c" else 1 for q in "abcdef"}


def test_silent_sequences_are_forgotten(spark, tmp_path):
    at = lambda h: {"timestamp": f"2026-01-01T{h:02d}:00:00Z"}
    for n, (q, pos, h) in enumerate([("a", 0, 1), ("b", 0, 9), ("b", 1, 10), ("a", 1, 11)]):
        put(tmp_path / "in", str(n), [message(q, pos, solid(40, 32, 32), **at(h))])
        start(messages.read_lines(spark, str(tmp_path / "in")), ManifestSink(settings(tmp_path)), str(tmp_path / "cp"), delay="1 hour", idle_s=3600).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out/log")).collect()
    assert {(r.seq_id, r.seq_pos): r.visual_reason for r in rows if r.is_keyframe} == {("a", 0): K.FIRST, ("b", 0): K.FIRST, ("a", 1): K.FIRST}
    assert len(rows) == 4 and rows[0].timestamp is not None


def test_mode_reaches_the_stream(spark, tmp_path, capsys):
    put(tmp_path / "in", "1", [message("desk/1", i, solid(v, 32, 32)) for i, v in enumerate([10, 10, 220])])
    (tmp_path / "c.yaml").write_text("pipeline: {mode: stream}\nmasking: {block_size: 8}\n")
    argv = ["--input", str(tmp_path / "in"), "--no-redact"]
    assert cli.main([*argv, "--output", str(tmp_path / "x"), "--mode", "stream"]) == 0 and cli.main([*argv, "--output", str(tmp_path / "y"), "--config", str(tmp_path / "c.yaml")]) == 0
    assert capsys.readouterr().out.count("Done: 2 keyframes from 3 frames.") == 2
    assert sorted(p.name for p in next((tmp_path / "y").glob("desk_1-*")).iterdir()) == ["frame_000000.png", "frame_000002.png"]


def test_keyframes_of_streams_are_redacted(spark, tmp_path):
    def engine():
        return lambda a: [([[0, 0], [8, 0], [8, 8], [0, 8]], "mail me@x.example", 0.9)]

    put(tmp_path / "in", "1", [message("a", 0, solid(200, 32, 32))])
    run_stream(spark, str(tmp_path / "in"), settings(tmp_path), pii.pattern_set(["email"]), engine)
    r = spark.read.parquet(str(tmp_path / "out/manifest")).first()
    a = pictures.decode(open(r.asset_path, "rb").read())
    assert r.pii_detected and a[:8, :8].max() == 0 and a[8:].min() == 200


# decoding


def encoded(a, depth, colour, kinds, palette=None, interlaced=False):
    """A PNG with the filters asked for, row by row: samples (height, width, n)."""
    n = a.shape[2]
    bpp = max(1, n * depth // 8)

    def packed(part):
        if depth == 16:
            return np.stack([part, 255 - part], axis=-1).reshape(len(part), -1)
        if depth == 8:
            return part.reshape(len(part), -1)
        bits = np.unpackbits(part.reshape(len(part), -1, 1), axis=2)[:, :, 8 - depth :].reshape(len(part), -1)
        return np.packbits(bits, axis=1)

    body = b""
    for x0, y0, dx, dy in pictures.PASSES if interlaced else [(0, 0, 1, 1)]:
        part = a[y0::dy, x0::dx]
        if not part.size:
            continue
        rows = packed(part).astype(int)
        for y, row in enumerate(rows):
            left = np.concatenate([np.zeros(bpp, int), row[:-bpp]]) if len(row) > bpp else np.zeros(len(row), int)
            up = rows[y - 1] if y else np.zeros(len(row), int)
            corner = np.concatenate([np.zeros(bpp, int), up[:-bpp]]) if len(row) > bpp else np.zeros(len(row), int)
            guess = left + up - corner
            near = [min((abs(g - v), i, v) for i, v in enumerate(t))[2] for g, *t in zip(guess, left, up, corner)]
            k = kinds[y % len(kinds)]
            body += bytes([k]) + ((row - [0 * row, left, up, (left + up) // 2, np.array(near)][k]) % 256).astype(np.uint8).tobytes()
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, colour, 0, 0, int(interlaced)))
    return pictures.PNG + head + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"") + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("interlaced", [False, True])
@pytest.mark.parametrize("kinds", [[0], [1], [2], [0, 1, 2], [3], [4], [4, 3, 2, 1, 0]])
@pytest.mark.parametrize(("colour", "depth"), [(2, 8), (6, 8), (0, 8), (4, 8), (2, 16), (0, 16), (0, 1), (0, 4), (3, 8), (3, 2)])
def test_png(colour, depth, kinds, interlaced):
    rng = np.random.default_rng(colour * 100 + depth)
    a = rng.integers(0, 1 << min(depth, 8), (11, 13, pictures.SAMPLES[colour])).astype(np.uint8)
    palette = rng.integers(0, 256, (256, 3)).astype(np.uint8) if colour == 3 else None
    got = pictures.decode(encoded(a, depth, colour, kinds, palette, interlaced))
    want = palette[a[..., 0]] if colour == 3 else imaging.to_rgb((a * (255 // ((1 << depth) - 1)) if depth < 8 else a)[..., : 3 if colour in (2, 6) else 1].astype(np.uint8))
    assert (got == want).all()


def test_jvm_agrees_on_png(spark):
    from framesift.sources.images import load_frame

    a = np.random.default_rng(1).integers(0, 256, (9, 10, 3)).astype(np.uint8)
    data = encoded(a, 8, 2, [4, 3, 1])
    assert (load_frame(spark, data) == pictures.decode(data)).all()


@pytest.mark.parametrize("up", [True, False])
def test_bmp(up):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (5, 3, 3)).astype(np.uint8)
    rows = a[::-1] if up else a
    for depth in (24, 32):
        body = b"".join((r[:, ::-1].tobytes() if depth == 24 else np.concatenate([r[:, ::-1], np.zeros((3, 1), np.uint8)], axis=1).tobytes()).ljust(-(-3 * depth // 32) * 4, b"\0") for r in rows)
        data = struct.pack("<2sIIIIiiHHIIIIII", b"BM", 54 + len(body), 0, 54, 40, 3, 5 if up else -5, 1, depth, 0, 0, 0, 0, 0, 0) + body
        assert (pictures.decode(data) == a).all()
    palette = rng.integers(0, 256, (4, 4)).astype(np.uint8)
    index = rng.integers(0, 4, (5, 3)).astype(np.uint8)
    body = b"".join(r.tobytes().ljust(4, b"\0") for r in (index[::-1] if up else index))
    data = struct.pack("<2sIIIIiiHHIIIIII", b"BM", 0, 0, 54 + 16, 40, 3, 5 if up else -5, 1, 8, 0, 0, 0, 0, 4, 0) + palette.tobytes() + body
    assert (pictures.decode(data) == palette[index][..., 2::-1]).all()


def test_pictures_that_cannot_be_decoded():
    good = imaging.png(solid(9, 6, 7))
    for bad in (b"", None, b"nothing", good[:30], good[:-30], good.replace(b"IHDR", b"IHDX"), pictures.PNG, b"BM" + b"\0" * 60, good[:60] + b"zzz" + good[63:]):
        with pytest.raises(pictures.BadPicture):
            pictures.decode(bad)


def test_decoding_a_column(spark):
    rows = [(1, bytearray(imaging.png(solid(9, 6, 7)))), (2, bytearray(b"no")), (3, None)]
    got = spark.createDataFrame(rows, "id int, picture binary").select("id", pictures.decoded(F.col("picture")).alias("d")).select("id", "d.*").orderBy("id").collect()
    assert bytes(got[0].frame.data) == solid(9, 6, 7).tobytes() and got[0].error is None
    assert got[1].frame is None and got[1].error.startswith("Could not load image") and got[2].frame is None
