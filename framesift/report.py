"""A page of a run: totals, tasks and the timeline of frames."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import numbering

STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:.3em .8em;border-bottom:1px solid #ccc;text-align:right}.k{color:#063}.s{color:#999}"


def render(manifest: DataFrame, task: str = "seq_id", frames_a_task: int = 200) -> str:
    """HTML of a manifest; the summaries are made by Spark, and at most frames_a_task lines of each task are shown."""
    total = numbering.summary(manifest).first()
    first = F.row_number().over(Window.partitionBy(task).orderBy("seq_pos"))
    shown = manifest.select(task, "seq_pos", "frame_id", "is_keyframe", "visual_reason", first.alias("_n")).where(F.col("_n") <= frames_a_task)
    shown = shown.groupBy(task).agg(F.array_sort(F.collect_list(F.struct("_n", "frame_id", "is_keyframe", "visual_reason"))).alias("shown"))
    tasks = numbering.summary(manifest, task).join(shown, task).orderBy(task).toLocalIterator()
    rows, lines = [], []
    for t in tasks:
        rows.append(f"<tr><td>{html.escape(str(t[task]))}</td><td>{t.num_frames}</td><td>{t.num_keyframes}</td><td>{t.skip_rate:.1%}</td></tr>")
        items = "".join(f'<li class="{"k" if f.is_keyframe else "s"}">{html.escape(f.frame_id or "")}: {html.escape(f.visual_reason or "")}</li>' for f in t.shown)
        lines.append(f"<h2>{html.escape(str(t[task]))}</h2><ol>{items}</ol>")
    data = json.dumps({"total_frames": total.num_frames, "total_keyframes": total.num_keyframes, "skip_rate": total.skip_rate}).replace("</", "<\\/")
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Keyframes</title><style>{STYLE}</style></head><body><h1>{total.num_keyframes} keyframes of {total.num_frames} frames</h1>"
        f"<p>{total.skip_rate:.1%} skipped</p><table><tr><th>Task</th><th>Frames</th><th>Keyframes</th><th>Skipped</th></tr>{''.join(rows)}</table>{''.join(lines)}"
        f"<script type='application/json' id='summary'>{data}</script></body></html>"
    )
