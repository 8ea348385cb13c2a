"""The cascade on streams: keyed state by sequence, rows of a micro-batch in order."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Settings
from ..functions import imaging
from ..operators.cascade import Features, Fold
from ..operators.masking import RunningMask
from ..schema import KEYFRAME, SKIPPED


FRAMES_OUT = "seq_id string, seq_pos long, event_type string, is_keyframe boolean, perceptual_hash string, ssim_score double, visual_reason string, n_changed int, n_masked int"


def stream_cascade(frames: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Decisions for a stream (seq_id string, seq_pos long, height int, width int, data binary). State is one keyframe, and the
    block means and change maps of the mask; its size doesn't grow. Frames count in the order they come; a micro-batch is sorted."""
    s = settings or Settings()
    m = s.masking

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, mask = Fold(s), RunningMask(m.block_size, m.window_size, m.noise_threshold)
        if state.exists:
            pixels, (mask.before, changes) = pickle.loads(state.get[0])
            mask.changes.extend(changes)
            fold.last = None if pixels is None else Features.of(pixels, s)
        rows = pd.concat(list(batches)).sort_values("seq_pos", kind="stable")
        out = []
        for pos, h, w, data in zip(rows["seq_pos"], rows["height"], rows["width"], rows["data"], strict=True):
            frame = imaging.from_bytes(data, h, w)
            masked = mask.step(frame)
            d = fold.step(frame, masked)
            out.append((key[0], pos, KEYFRAME if d.keyframe else SKIPPED, d.keyframe, d.hash, d.ssim, d.reason, len(d.regions), len(masked)))
        state.update((pickle.dumps((None if fold.last is None else fold.last.pixels, (mask.before, list(mask.changes)))),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAMES_OUT.split(", ")])

    return frames.groupBy("seq_id").applyInPandasWithState(run, FRAMES_OUT, "state binary", "append", GroupStateTimeout.NoTimeout)


def stream_scalar_keyframes(events: DataFrame, seq: str, order: list[str], value: str, least: float) -> DataFrame:
    """(seq, order columns, is_keyframe, ref_value) of the fold over one value, on a stream."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in (seq, *order)) + ", is_keyframe boolean, ref_value double"

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        flags, refs = [], []
        for v in rows[value]:
            hit = pd.notna(v) and (last is None or abs(v - last) >= least)
            flags.append(bool(hit))
            refs.append(last)
            last = float(v) if hit else last
        if last is not None:
            state.update((last,))
        out = rows[[*order]].copy()
        out.insert(0, seq, key[0])
        out["is_keyframe"], out["ref_value"] = flags, pd.array(refs, dtype="Float64").to_numpy(float, na_value=np.nan) if refs else []
        yield out

    return events.select(seq, *order, value).groupBy(seq).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.NoTimeout)
