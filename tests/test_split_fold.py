"""The split fold gives what the fold in one task gives, in every column."""

import numpy as np
import pytest
from framesift.config import Settings
from framesift.operators import cascade as K
from framesift.operators import split_fold
from test_cascade import solid

SCHEMA = "seq_id string, seq_pos long, frame_id string, app_name string, frame struct<height:int,width:int,data:binary>"


def table(spark, sequences):
    rows = [(s, i, f"{s}-{i}", f"app{i % 3}", (a.shape[0], a.shape[1], bytearray(a.tobytes()))) for s, pictures in sequences for i, a in enumerate(pictures)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def restless(n, rng):
    """Screens that change now and then, with a corner that always does and frames of other sizes."""
    out, base = [], 60
    for i in range(n):
        if rng.random() < 0.15:
            base = int(rng.integers(0, 256))
        h, w = (48, 64) if rng.random() < 0.97 else (40, 40) if rng.random() < 0.7 else (3, 5)
        a = solid(base, h, w)
        a[:8, :8] = rng.integers(0, 256)
        if rng.random() < 0.3 and h > 8:
            a[24:32, 8:24] = rng.integers(0, 256)
        out.append(a)
    return out


CASES = {
    "restless": lambda rng: [("a", restless(150, rng))],
    "still": lambda rng: [("a", [solid(10, 32, 32)] * 5 + [solid(200, 32, 32)] * 145)],  # one keyframe that most segments never see
    "slow": lambda rng: [("a", [solid(int(v), 32, 32) for v in np.linspace(0, 255, 160)])],  # a guess may never meet the truth
    "several": lambda rng: [("a", restless(60, rng)), ("b", restless(1, rng)), (None, restless(40, rng)), ("c", restless(3, rng)), ("d", restless(70, rng))],
    "alternating": lambda rng: [("a", [solid([30, 220][i % 2], 32, 32) for i in range(120)])],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("early", [1, 8])
def test_split_equals_one_task(spark, case, early, monkeypatch):
    monkeypatch.setattr(split_fold, "EARLY", early)
    s = Settings.of({"masking": {"block_size": 8, "window_size": 5, "noise_threshold": 0.6}, "hasher": {"hash_size": 4}, "comparator": {"min_changed_blocks": 2}})
    f = table(spark, CASES[case](np.random.default_rng(11)))
    rows = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = rows(K.cascade(f, s))
    got = rows(K.cascade(f, s, split=7))
    assert got == want and (case == "slow" or any("Row(x=" in r for r in want) or case in ("still", "alternating"))


def test_rounds_end_and_are_few(spark, monkeypatch):
    """Each round folds only what begins otherwise than was thought."""
    asked = []
    plain = split_fold.refolded
    monkeypatch.setattr(split_fold, "refolded", lambda f, s, g, n, c: asked.append(n) or plain(f, s, g, n, c))
    s = Settings.of({"masking": {"block_size": 8, "window_size": 5}, "hasher": {"hash_size": 4}})
    K.cascade(table(spark, CASES["restless"](np.random.default_rng(3))), s, split=6).count()
    assert asked[0] == 5 and len(asked) <= 3


def test_no_frames(spark):
    assert K.cascade(table(spark, []), split=4).count() == 0


def test_pixels_are_dealt_and_sorted_once(spark):
    plan = K.cascade(table(spark, [("a", [solid(1)])]))._jdf.queryExecution().executedPlan().toString()
    after = plan.split("AdaptiveSparkPlan", 1)[-1]
    assert "Window" not in after and after.count("Sort [") == 1 and after.count("Exchange hashpartitioning(seq_id") == 1
