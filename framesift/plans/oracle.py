"""The same queries in DuckDB's SQL, written on long-form pixels."""

from __future__ import annotations

from ..operators import pii

SIDE, BLOCK = 8, 2
N = SIDE // BLOCK

E = """e AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, embedding FROM embeddings)"""
PX = f"""{E}, px0 AS (SELECT vec_id, label, rn, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM e),
px AS (SELECT vec_id, label, rn, i // {SIDE} AS y, i % {SIDE} AS x, CAST(floor(least(greatest((CAST(v AS DOUBLE) + 1) * 127.5, 0), 255)) AS INTEGER) AS p FROM px0)"""
MEANS = f"{PX}, bm AS (SELECT vec_id, label, rn, y // {BLOCK} AS r, x // {BLOCK} AS c, avg(p) AS m FROM px GROUP BY ALL)"
HASH = f"""{PX}, ks AS (SELECT unnest([1, 2]) AS k),
co AS (SELECT vec_id, label, rn, y, k, round(sum(p * 2 * cos(pi() * k * (x + 0.5) / {SIDE})), 6) AS d FROM px, ks WHERE y < 2 GROUP BY ALL),
bits AS (SELECT *, CASE WHEN d > avg(d) OVER (PARTITION BY vec_id) THEN 1 ELSE 0 END AS b FROM co),
h AS (SELECT vec_id, label, rn, CAST(sum(b * power(2, 3 - (2 * y + k - 1))) AS INTEGER) AS hv FROM bits GROUP BY ALL)"""
HEX = "lower(to_hex({}))"
#: All pairs (a before b) of a label that are wanted by `{on}`: changed blocks and similarity.
PAIRS = f"""pp AS (SELECT a.label, a.rn AS ra, b.rn AS rb, b.vec_id, a.y, a.x, a.p AS p, b.p AS q,
 trunc(0.2989 * a.p + 0.5870 * a.p + 0.1140 * a.p) AS g, trunc(0.2989 * b.p + 0.5870 * b.p + 0.1140 * b.p) AS k
 FROM px a JOIN px b ON a.label = b.label AND a.y = b.y AND a.x = b.x AND {{on}}),
nb AS (SELECT label, ra, rb, vec_id, count(*) FILTER (WHERE d > 10) AS n FROM (SELECT label, ra, rb, vec_id, avg(abs(p - q)) AS d FROM pp GROUP BY label, ra, rb, vec_id, y // {BLOCK}, x // {BLOCK}) GROUP BY ALL),
ws AS (SELECT unnest([0, 0, 1, 1]) AS wy, unnest([0, 1, 0, 1]) AS wx),
wi AS (SELECT label, ra, rb, wy, wx, avg(g) AS ux, avg(k) AS uy, avg(g * g) AS xx, avg(k * k) AS yy, avg(g * k) AS xy
 FROM pp JOIN ws ON y BETWEEN wy AND wy + 6 AND x BETWEEN wx AND wx + 6 GROUP BY ALL),
si AS (SELECT label, ra, rb, avg(((2 * ux * uy + 6.5025) * (2 * 49.0 / 48 * (xy - ux * uy) + 58.5225)) / ((ux * ux + uy * uy + 6.5025) * (49.0 / 48 * (xx - ux * ux) + 49.0 / 48 * (yy - uy * uy) + 58.5225))) AS s FROM wi GROUP BY ALL),
cmp AS (SELECT nb.label, nb.ra, nb.rb, nb.vec_id, n, s FROM nb JOIN si USING (label, ra, rb))"""
PREV = PX + ", " + PAIRS.format(on="a.rn + 1 = b.rn")
MAG = "CASE WHEN s < 0.70 OR n > 15 THEN 'major' WHEN s < 0.90 OR n > 5 THEN 'moderate' ELSE 'minor' END"
WALK = f"""{HASH}, {PAIRS.format(on="a.rn < b.rn")},
mu AS (SELECT label, rn, avg(p) AS mean FROM px GROUP BY ALL),
pr AS (SELECT cmp.*, ha.hv = hb.hv AND abs(ma.mean - mb.mean) < 5 AS gate FROM cmp
 JOIN h ha ON ha.label = cmp.label AND ha.rn = ra JOIN h hb ON hb.label = cmp.label AND hb.rn = rb
 JOIN mu ma ON ma.label = cmp.label AND ma.rn = ra JOIN mu mb ON mb.label = cmp.label AND mb.rn = rb),
walk AS (SELECT label, rn, rn AS kf, CAST(NULL AS BIGINT) AS before, true AS is_kf, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS BIGINT) AS n, false AS gate FROM e WHERE rn = 1
 UNION ALL SELECT w.label, w.rn + 1, CASE WHEN NOT gt AND (ps <= 0.25 OR pn > 14) THEN w.rn + 1 ELSE w.kf END, w.kf, NOT gt AND (ps <= 0.25 OR pn > 14), CASE WHEN gt THEN NULL ELSE ps END, CASE WHEN gt THEN NULL ELSE pn END, gt
 FROM walk w JOIN (SELECT label AS pl, ra, rb, s AS ps, n AS pn, gate AS gt FROM pr) ON pl = w.label AND ra = w.kf AND rb = w.rn + 1),
ca AS (SELECT e.vec_id, walk.*, pk.vec_id AS before_id, h.hv FROM walk JOIN e ON e.label = walk.label AND e.rn = walk.rn LEFT JOIN e pk ON pk.label = walk.label AND pk.rn = walk.before JOIN h ON h.vec_id = e.vec_id)"""
CASCADE = f"WITH RECURSIVE {WALK} "
REASON = """CASE WHEN before IS NULL THEN 'First frame in sequence' WHEN gate THEN 'Hash match — visually identical to previous keyframe'
 WHEN s <= 0.25 THEN 'Significant change — SSIM ' || printf('%.4f', s) || ', ' || printf('%.1f', n / 16.0 * 100) || '% of blocks changed'
 WHEN n > 14 THEN 'Localized change — SSIM ' || printf('%.4f', s) || ' above threshold but ' || n || ' blocks changed (>14)'
 ELSE 'Minor change — SSIM ' || printf('%.4f', s) || ' above threshold 0.25, ' || n || ' blocks changed (≤14)' END"""

MASK = f"""{MEANS}, ch AS (SELECT *, CASE WHEN lag(m) OVER w IS NULL THEN NULL WHEN abs(m - lag(m) OVER w) > 5 THEN 1 ELSE 0 END AS ch FROM bm WINDOW w AS (PARTITION BY label, r, c ORDER BY rn)),
mk AS (SELECT vec_id, label, rn, r, c, count(ch) OVER w >= 2 AND avg(ch) OVER w > 0.8 AS noisy FROM ch WINDOW w AS (PARTITION BY label, r, c ORDER BY rn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""
EV = """ev AS (SELECT event_id, user_id, ts, epoch_us(ts) / 1e6 AS secs, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no, event_type IN ('purchase', 'signup') AS is_keyframe FROM events)"""
SAMPLE = f"""{EV}, sm AS (SELECT * FROM ev WHERE frame_no % 3 = 0),
tr AS (SELECT * FROM (SELECT user_id, frame_no, is_keyframe, lag(frame_no) OVER w AS prev_no, lag(is_keyframe) OVER w AS before FROM sm WINDOW w AS (PARTITION BY user_id ORDER BY frame_no)) WHERE is_keyframe AND NOT before)"""
BACK = f"{SAMPLE}, bf AS (SELECT ev.* FROM ev JOIN tr ON ev.user_id = tr.user_id AND ev.frame_no > prev_no AND ev.frame_no < tr.frame_no)"
SPEECH = f"""{EV}, sp AS (SELECT user_id, frame_no AS seg_pos, secs AS s0, secs + 3600 AS s1, event_type || '-' || event_id AS txt FROM ev WHERE event_type = 'purchase'),
al AS (SELECT ev.event_id, string_agg(txt, ' | ' ORDER BY seg_pos) AS transcript_segment FROM ev JOIN sp ON ev.user_id = sp.user_id AND secs BETWEEN s0 AND s1 GROUP BY ALL)"""
SCALAR = """WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (SELECT event_id, user_id, rn, true AS is_keyframe, CAST(NULL AS DOUBLE) AS ref_value, value AS held FROM r WHERE rn = 1
 UNION ALL SELECT r.event_id, r.user_id, r.rn, abs(r.value - held) >= 50, held, CASE WHEN abs(r.value - held) >= 50 THEN r.value ELSE held END FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
SELECT event_id, is_keyframe, ref_value FROM w"""

def _windows(rows: int) -> list[list[int]]:
    """Places of the pixels of each 7 x 7 window, from 1."""
    return [[(wy + k // 7) * SIDE + wx + k % 7 + 1 for k in range(49)] for wy in range(rows - 6) for wx in range(SIDE - 6)]


def _squares(rows: int) -> list[list[int]]:
    """Of each 2 x 2 block."""
    return [[(2 * (b // N) + dy) * SIDE + 2 * (b % N) + dx + 1 for dy in (0, 1) for dx in (0, 1)] for b in range(rows // BLOCK * N)]


_MEAN = "list_avg(list_transform(ii, lambda i: {}))"
_UX, _UY, _XX, _YY, _XY = (_MEAN.format(x) for x in ("kg[i]", "g[i]", "kg[i] * kg[i]", "g[i] * g[i]", "kg[i] * g[i]"))
_COV = f"49.0 / 48 * ({_XY} - {_UX} * {_UY})"
_SSIM = f"list_avg(list_transform(WINDOWS, lambda ii: ((2 * {_UX} * {_UY} + 6.5025) * (2 * {_COV} + 58.5225)) / (({_UX} * {_UX} + {_UY} * {_UY} + 6.5025) * (49.0 / 48 * ({_XX} - {_UX} * {_UX}) + 49.0 / 48 * ({_YY} - {_UY} * {_UY}) + 58.5225))))"


def masked_walk(seq: str, threshold: float, rows: int = SIDE, changed: int = 14) -> str:
    """The cascade on masked frames, compared one after the other with the keyframe that the walk holds. Frames of 16 rows are two frames of
    a sequence, one above the other, each a tile with a hash and a mean of its own."""
    ssim = _SSIM.replace("WINDOWS", str(_windows(rows)))
    gate = "f.hv = w.khv AND list_max(list_transform(range(len(f.mean)), lambda i: abs(f.mean[i + 1] - w.kmean[i + 1]))) < 5"
    tall = E.replace("e AS (", "e0 AS (") + ", e AS (SELECT a.vec_id, a.label, (a.rn + 1) // 2 AS rn, list_concat(a.embedding, b.embedding) AS embedding FROM e0 a JOIN e0 b ON a.label = b.label AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1)"
    return f"""WITH RECURSIVE {MASK.replace(E, E if rows == SIDE else tall).replace("avg(ch) OVER w > 0.8", f"avg(ch) OVER w > {threshold}").replace("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id)", f"SELECT vec_id, {seq} AS label, row_number() OVER (PARTITION BY {seq} ORDER BY vec_id)")},
mp AS (SELECT px.vec_id, px.label, px.rn, y, x, CASE WHEN noisy THEN 0 ELSE p END AS p FROM px JOIN mk ON mk.vec_id = px.vec_id AND r = y // {BLOCK} AND c = x // {BLOCK}),
ms AS (SELECT vec_id, string_agg(c * 2 || ':' || r * 2 || ':2:2', ',' ORDER BY r, c) AS masks, CAST(count(*) AS INTEGER) AS n_masked FROM mk WHERE noisy GROUP BY vec_id),
co AS (SELECT vec_id, y // {SIDE} AS tile, y % {SIDE} AS y, k, round(sum(p * 2 * cos(pi() * k * (x + 0.5) / {SIDE})), 6) AS d FROM mp, (SELECT unnest([1, 2]) AS k) WHERE y % {SIDE} < 2 GROUP BY ALL),
ht AS (SELECT vec_id, tile, CAST(sum(b * power(2, 3 - (2 * y + k - 1))) AS INTEGER) AS hv FROM (SELECT *, CASE WHEN d > avg(d) OVER (PARTITION BY vec_id, tile) THEN 1 ELSE 0 END AS b FROM co) GROUP BY vec_id, tile),
hs AS (SELECT vec_id, list(hv ORDER BY tile) AS hv, list(mean ORDER BY tile) AS mean FROM ht JOIN (SELECT vec_id, y // {SIDE} AS tile, avg(p) AS mean FROM mp GROUP BY ALL) USING (vec_id, tile) GROUP BY vec_id),
fr AS (SELECT vec_id, label, rn, list(p ORDER BY y, x) AS px, list(CAST(trunc(0.2989 * p + 0.5870 * p + 0.1140 * p) AS BIGINT) ORDER BY y, x) AS g FROM mp GROUP BY ALL),
fs AS (SELECT fr.*, hv, mean, masks, coalesce(n_masked, 0) AS n_masked FROM fr JOIN hs USING (vec_id) LEFT JOIN ms USING (vec_id)),
wk AS (
 SELECT vec_id, label, rn, true AS is_kf, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS VARCHAR) AS regions, CAST(NULL AS BIGINT) AS n, false AS gate, CAST(NULL AS BIGINT) AS before_id, vec_id AS kid, px AS kpx, g AS kg, hv AS khv, mean AS kmean FROM fs WHERE rn = 1
 UNION ALL
 SELECT vec_id, label, rn, kf, s, regions, n, gate, kid, CASE WHEN kf THEN vec_id ELSE kid END, CASE WHEN kf THEN px ELSE kpx END, CASE WHEN kf THEN g ELSE kg END, CASE WHEN kf THEN hv ELSE khv END, CASE WHEN kf THEN mean ELSE kmean END
 FROM (SELECT *, NOT gate AND (s <= 0.25 OR n > {changed}) AS kf FROM (
  SELECT f.vec_id, f.label, f.rn, f.px, f.g, f.hv, f.mean, w.kid, w.kpx, w.kg, w.khv, w.kmean, {gate} AS gate, CASE WHEN {gate} THEN NULL ELSE {ssim} END AS s,
   list_filter(range({rows // BLOCK * N}), lambda b: list_avg(list_transform({_squares(rows)}[b + 1], lambda i: abs(f.px[i] - w.kpx[i]))) > 10) AS changed,
   CASE WHEN {gate} THEN NULL ELSE len(changed) END AS n, CASE WHEN NOT ({gate}) AND len(changed) > 0 THEN list_aggregate(list_transform(changed, lambda b: (b % {N}) * 2 || ':' || (b // {N}) * 2 || ':2:2'), 'string_agg', ',') END AS regions
  FROM wk w JOIN fs f ON f.label = w.label AND f.rn = w.rn + 1))),
ca AS (SELECT wk.*, before_id AS before, hv, masks, n_masked FROM wk JOIN fs USING (vec_id)) """


def _sql(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


def _count(column: str) -> str:
    return ", ".join(f"CAST(len(regexp_extract_all({column}, {_sql(p.regex)})) AS INTEGER) AS n_{p.name}" for p in pii.BUILTIN)


def _each(table: str, key: str, column: str, patterns) -> str:
    return " UNION ALL ".join(f"SELECT {key}, '{n}' AS pattern, unnest(regexp_extract_all({column}, {_sql(r)})) AS matched FROM {table}" for n, r in patterns)


def _redacted(column: str) -> str:
    for p in pii.BUILTIN:
        column = f"regexp_replace({column}, {_sql(p.regex)}, '[REDACTED]', 'g')"
    return column


BUILTIN = [(p.name, p.regex) for p in pii.BUILTIN]
TALL = f"{HASH}, ta AS (SELECT a.label, CAST((a.rn - 1) // 2 AS INTEGER) AS pair, a.hv AS h1, b.hv AS h2 FROM h a JOIN h b ON a.label = b.label AND b.rn = a.rn + 1 WHERE a.rn % 2 = 1)"
CUES = r"""SELECT conv_id, CAST(turn * 5 AS DOUBLE) + 0.25 AS "start", CAST(turn * 5 + 4 AS DOUBLE) + 0.5 AS "end",
 array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS text FROM conversations"""

ORACLE_SQL = {
    "frame_load": f"WITH {PX} SELECT vec_id, 8 AS height, 8 AS width, 192 AS n_bytes, round(avg(p), 4) AS mean FROM px GROUP BY vec_id",
    "block_means": f"WITH {MEANS} SELECT vec_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, round(m, 4) AS mean FROM bm",
    "channel_means": f"WITH {PX} SELECT vec_id, round(avg(p), 4) AS mean_r, round(avg(p), 4) AS mean_g, round(avg(p), 4) AS mean_b FROM px GROUP BY vec_id",
    "changed_blocks": f"WITH {PREV} SELECT vec_id, CAST(n AS INTEGER) AS n_changed FROM nb",
    "changed_pct": f"WITH {PREV} SELECT vec_id, round(n / 16.0 * 100, 4) AS changed_pct FROM nb",
    "phash": f"WITH {HASH} SELECT vec_id, {HEX.format('hv')} AS perceptual_hash FROM h",
    "phash_tiled": f"WITH {TALL} SELECT label, pair, true AS tall, 2 AS n_tiles, {HEX.format('h1')} AS hash_1, {HEX.format('h2')} AS hash_2 FROM ta",
    "hamming": f"WITH {HASH} SELECT vec_id, CAST(bit_count(xor(hv, b)) AS INTEGER) AS distance FROM (SELECT vec_id, hv, lag(hv) OVER (PARTITION BY label ORDER BY rn) AS b FROM h) WHERE b IS NOT NULL",
    "hash_match": f"WITH {HASH}, d AS (SELECT vec_id, bit_count(xor(hv, b)) AS d FROM (SELECT vec_id, hv, lag(hv) OVER (PARTITION BY label ORDER BY rn) AS b FROM h) WHERE b IS NOT NULL) SELECT vec_id, d = 0 AS match_0, d <= 1 AS match_1, d <= 2 AS match_2 FROM d",
    "tiled_match": f"WITH {TALL}, l AS (SELECT *, lag(h1) OVER w AS b1, lag(h2) OVER w AS b2 FROM ta WINDOW w AS (PARTITION BY label ORDER BY pair)) SELECT label, pair, h1 = b1 AND h2 = b2 AS match_0, bit_count(xor(h1, b1)) <= 2 AND bit_count(xor(h2, b2)) <= 2 AS match_2 FROM l WHERE b1 IS NOT NULL",
    "ssim_prev": f"WITH {PREV} SELECT vec_id, round(s, 4) AS ssim_score FROM cmp",
    "compare_frames": f"WITH {PREV} SELECT vec_id, round(s, 4) AS ssim_score, round(1 - s, 4) AS change_score, round(n / 16.0 * 100, 4) AS changed_pct, CAST(n AS INTEGER) AS n_changed FROM cmp",
    "change_magnitude": f"WITH {PREV} SELECT vec_id, {MAG} AS change_magnitude FROM cmp",
    "keyframe_predicate": f"WITH {PREV} SELECT vec_id, s <= 0.25 OR n > 14 AS is_keyframe FROM cmp",
    "region_area": "SELECT vec_id, CAST((vec_id % 7 + 1) * (vec_id % 5 + 1) AS INTEGER) AS area FROM embeddings",
    "region_clamp": """WITH g AS (SELECT vec_id, CAST(vec_id AS INTEGER) % 13 - 4 AS x, CAST(vec_id AS INTEGER) % 11 - 4 AS y, CAST(vec_id AS INTEGER) % 7 + 1 AS w, CAST(vec_id AS INTEGER) % 5 + 1 AS h FROM embeddings)
 SELECT vec_id, greatest(x, 0) AS x, greatest(y, 0) AS y, greatest(least(x + w, 8) - greatest(x, 0), 0) AS w, greatest(least(y + h, 8) - greatest(y, 0), 0) AS h FROM g""",
    "box_from_quad": """WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 100) AS INTEGER) AS a FROM embeddings)
 SELECT vec_id, min(a) FILTER (WHERE i % 2 = 0) AS x, min(a) FILTER (WHERE i % 2 = 1) AS y, max(a) FILTER (WHERE i % 2 = 0) - min(a) FILTER (WHERE i % 2 = 0) AS w, max(a) FILTER (WHERE i % 2 = 1) - min(a) FILTER (WHERE i % 2 = 1) AS h FROM v WHERE i < 8 GROUP BY vec_id""",
    "adaptive_mask": f"WITH {MASK} SELECT vec_id, CAST(count(*) FILTER (WHERE noisy) AS INTEGER) AS n_masked FROM mk GROUP BY vec_id",
    "mask_regions": f"WITH {MASK} SELECT vec_id, CAST(c * 2 AS INTEGER) AS x, CAST(r * 2 AS INTEGER) AS y, 2 AS w, 2 AS h FROM mk WHERE noisy",
    "mask_apply": f"WITH {MASK} SELECT px.vec_id, round(avg(CASE WHEN noisy THEN 0 ELSE p END), 4) AS mean FROM px JOIN mk ON mk.vec_id = px.vec_id AND r = y // 2 AND c = x // 2 GROUP BY px.vec_id",
    "mask_reset": """WITH g AS (SELECT vec_id, label, vec_id // 37 % 3 AS rows_ FROM embeddings), u AS (SELECT *, lag(rows_) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM g WHERE rows_ > 0),
 s AS (SELECT vec_id, sum(CASE WHEN b IS NOT NULL AND b <> rows_ THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS segment FROM u) SELECT g.vec_id, CAST(segment AS INTEGER) AS segment FROM g LEFT JOIN s USING (vec_id)""",
    "cascade_keyframes": CASCADE + "SELECT vec_id, is_kf AS is_keyframe, CASE WHEN is_kf THEN 'KEYFRAME' ELSE 'SKIPPED' END AS event_type, round(s, 4) AS ssim_score FROM ca",
    "cascade_reasons": CASCADE + f"SELECT vec_id, {REASON} AS visual_reason FROM ca",
    "prev_keyframe_links": CASCADE + "SELECT vec_id, CAST(before_id AS VARCHAR) AS prev_keyframe_id, './output/' || before_id || '.png' AS prev_keyframe_path FROM ca",
    "keyframe_filter": CASCADE + "SELECT CAST(vec_id AS VARCHAR) AS frame_id, './output/' || vec_id || '.png' AS asset_path, round(n / 16.0 * 100, 4) AS changed_pct FROM ca WHERE is_kf",
    "task_summary": CASCADE + "SELECT CAST(label AS VARCHAR) AS seq_id, count(*) AS num_frames, count(*) FILTER (WHERE is_kf) AS num_keyframes, round(1 - count(*) FILTER (WHERE is_kf) / count(*), 6) AS skip_rate, round(100 * count(*) FILTER (WHERE is_kf) / count(*), 1) AS keyframe_pct FROM ca GROUP BY label",
    "global_summary": CASCADE + "SELECT count(*) AS total_frames, count(*) FILTER (WHERE is_kf) AS total_keyframes, round(1 - count(*) FILTER (WHERE is_kf) / count(*), 6) AS skip_rate FROM ca",
    "manifest": CASCADE
    + f"""SELECT CAST(label AS VARCHAR) AS seq_id, CAST(vec_id AS VARCHAR) AS frame_id, CAST(NULL AS TIMESTAMP) AS timestamp, CASE WHEN is_kf THEN 'KEYFRAME' ELSE 'SKIPPED' END AS event_type, CAST(NULL AS VARCHAR) AS app_name, CAST(NULL AS VARCHAR) AS window_title,
 is_kf AS is_keyframe, {HEX.format('hv')} AS perceptual_hash, round(s, 4) AS ssim_score, round(1 - s, 4) AS change_score, round(n / 16.0 * 100, 4) AS changed_pct, CAST(CASE WHEN n > 0 THEN n END AS INTEGER) AS changed_regions, false AS adaptive_mask, 8 AS frame_width, 8 AS frame_height,
 CAST(NULL AS VARCHAR) AS source_format, CASE WHEN is_kf THEN './output/' || vec_id || '.png' END AS asset_path, CAST(NULL AS BOOLEAN) AS pii_detected, {REASON} AS visual_reason, CAST(before_id AS VARCHAR) AS prev_keyframe_id, './output/' || before_id || '.png' AS prev_keyframe_path,
 CAST(NULL AS VARCHAR) AS source_video, CAST(NULL AS DOUBLE) AS video_timestamp, CAST(NULL AS INTEGER) AS video_frame_number, CAST(NULL AS DOUBLE) AS time_since_prev_keyframe, CAST(NULL AS VARCHAR) AS audio_activity, CAST(NULL AS VARCHAR) AS transcript_segment,
 CASE WHEN is_kf THEN CAST(count(*) FILTER (WHERE is_kf) OVER (PARTITION BY label ORDER BY rn) AS INTEGER) END AS keyframe_index, CASE WHEN is_kf THEN CAST(count(*) FILTER (WHERE is_kf) OVER (PARTITION BY label) AS INTEGER) END AS total_keyframes, CAST(NULL AS DOUBLE) AS video_duration,
 CASE WHEN is_kf THEN CASE WHEN s IS NULL THEN 'major' ELSE {MAG} END END AS change_magnitude FROM ca""",
    "scalar_keyframes": SCALAR,
    "stream_keyframes": SCALAR,
    "coarse_sample": f"WITH {SAMPLE} SELECT event_id, user_id, frame_no FROM sm",
    "transitions": f"WITH {SAMPLE} SELECT user_id, prev_no, frame_no FROM tr",
    "backfill": f"WITH {BACK} SELECT event_id, user_id, frame_no FROM bf",
    "ordered_merge": f"WITH {BACK} SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY frame_no) AS INTEGER) AS merged_no FROM (SELECT * FROM sm UNION ALL SELECT * FROM bf)",
    "range_scan": f"WITH {EV} SELECT event_id, user_id, frame_no, round(frame_no / 30.0, 6) AS video_timestamp FROM ev WHERE frame_no >= 10 AND frame_no < 20",
    "keyframe_index": f"WITH {EV} SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS keyframe_index, 'step_' || printf('%03d', row_number() OVER w) AS frame_id FROM ev WHERE is_keyframe WINDOW w AS (PARTITION BY user_id ORDER BY frame_no)",
    "total_keyframes": f"WITH {EV} SELECT event_id, CASE WHEN is_keyframe THEN CAST(count(*) FILTER (WHERE is_keyframe) OVER (PARTITION BY user_id) AS INTEGER) END AS total_keyframes FROM ev",
    "time_since_prev": f"WITH {EV} SELECT event_id, round(secs - lag(secs) OVER (PARTITION BY user_id ORDER BY frame_no), 3) AS time_since_prev_keyframe FROM ev WHERE is_keyframe",
    "prior_action": f"WITH {EV} SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY frame_no) AS action FROM ev",
    "first_tasks": f"WITH {EV}, f AS (SELECT user_id FROM (SELECT user_id, ts, event_id FROM ev WHERE frame_no = 0) ORDER BY ts, event_id LIMIT 10) SELECT event_id, user_id, frame_no FROM ev WHERE user_id IN (SELECT user_id FROM f)",
    "speech_runs": f"""WITH {EV}, f AS (SELECT user_id, frame_no, (max(frame_no) OVER (PARTITION BY user_id) + 1) * 0.5 AS duration, value - 100 > -40 AS loud FROM ev),
 i AS (SELECT user_id, frame_no, duration, frame_no - row_number() OVER (PARTITION BY user_id ORDER BY frame_no) AS k FROM f WHERE loud),
 g AS (SELECT user_id, min(frame_no) * 0.5 AS s0, least((max(frame_no) + 1) * 0.5, any_value(duration)) AS s1 FROM i GROUP BY user_id, k)
 SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY s0) - 1 AS INTEGER) AS seg_pos, CAST(s0 AS DOUBLE) AS "start", CAST(s1 AS DOUBLE) AS "end", '[speech]' AS text FROM g""",
    "audio_activity": f"WITH {SPEECH} SELECT event_id, CASE WHEN is_keyframe THEN CASE WHEN event_id IN (SELECT event_id FROM al) THEN 'speech' ELSE 'silence' END END AS audio_activity FROM ev",
    "transcript_align": f"WITH {SPEECH} SELECT ev.event_id, transcript_segment FROM ev LEFT JOIN al USING (event_id)",
    "transcript_activity": f"WITH {SPEECH} SELECT ev.event_id, CASE WHEN is_keyframe THEN CASE WHEN transcript_segment <> '' THEN 'speech' ELSE 'silence' END END AS audio_activity FROM ev LEFT JOIN al USING (event_id)",
    "transcript_parse": CUES,
    "vtt_parse": f'SELECT conv_id, count(*) AS n_cues, max("end") AS last_end FROM ({CUES}) GROUP BY conv_id',
    "pii_counts": f"SELECT doc_id, {_count('text')} FROM documents",
    "pii_counts_pages": f"SELECT page_id, {_count('html')} FROM pages",
    "pii_matches": f"SELECT doc_id, pattern, matched, count(*) AS n FROM ({_each('documents', 'doc_id', 'text', BUILTIN)}) GROUP BY ALL",
    "pii_flag": "SELECT doc_id, " + " OR ".join(f"regexp_matches(text, {_sql(r)})" for _, r in BUILTIN) + " AS pii_detected FROM documents",
    "pii_redact_text": f"SELECT doc_id, md5({_redacted('text')}) AS redacted_md5 FROM documents",
    "pii_custom_patterns": "SELECT doc_id, pattern, count(*) AS n FROM (" + _each("documents", "doc_id", "text", [(n, r) for n, r in BUILTIN if n != "ip_address"] + [("license", r"\b(?:MIT|Apache|GPL)\b")]) + ") GROUP BY ALL",
    "image_scan": f"WITH {PX} SELECT vec_id, 'png' AS source_format, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS seq_pos, round(avg(p), 4) AS mean FROM px GROUP BY vec_id",
    "image_scan_all": f"WITH {PX} SELECT label, vec_id, 'png' AS source_format, CAST(rn - 1 AS INTEGER) AS seq_pos, round(avg(p), 4) AS mean FROM px GROUP BY label, vec_id, rn",
    "ocr_redaction": CASCADE.rstrip()
    + """, lf AS (SELECT vec_id, avg(p) FILTER (WHERE x < 4) < 120 AS dark, avg(p) AS m, avg(CASE WHEN x < 4 THEN 0 ELSE p END) AS md FROM px GROUP BY vec_id)
 SELECT ca.vec_id, is_kf AS is_keyframe, CASE WHEN is_kf THEN dark END AS pii_detected, round(CASE WHEN is_kf AND dark THEN md ELSE m END, 4) AS mean FROM ca JOIN lf ON lf.vec_id = ca.vec_id""",
    "stream_cascade": CASCADE + "SELECT vec_id, is_kf AS is_keyframe, CASE WHEN is_kf THEN 'KEYFRAME' ELSE 'SKIPPED' END AS event_type, round(s, 4) AS ssim_score FROM ca",
    "cascade_split": masked_walk("0", 0.6) + f"SELECT vec_id, is_kf AS is_keyframe, round(s, 4) AS ssim_score, regions AS changed_regions, masks AS adaptive_mask, CAST(before_id AS VARCHAR) AS prev_keyframe_id, {REASON} AS visual_reason FROM ca",
    "cascade_masked": masked_walk("label", 0.6) + f"SELECT vec_id, is_kf AS is_keyframe, round(s, 4) AS ssim_score, regions AS changed_regions, masks AS adaptive_mask, CAST(before_id AS VARCHAR) AS prev_keyframe_id, {REASON} AS visual_reason FROM ca",
    "stream_messages": masked_walk("label", 0.6)
    + f"""SELECT vec_id, is_kf AS is_keyframe, round(s, 4) AS ssim_score, regions AS changed_regions, masks AS adaptive_mask, CAST(before_id AS VARCHAR) AS prev_keyframe_id, {REASON} AS visual_reason, false AS late, 'editor' AS app_name,
 CASE WHEN is_kf THEN CAST(count(*) FILTER (WHERE is_kf) OVER (PARTITION BY label ORDER BY rn) AS INTEGER) END AS keyframe_index, CASE WHEN is_kf THEN CAST(count(*) FILTER (WHERE is_kf) OVER (PARTITION BY label) AS INTEGER) END AS total_keyframes FROM ca""",
    "picture_decode": f"WITH {PX} SELECT vec_id, 8 AS height, 8 AS width, CAST(NULL AS VARCHAR) AS error, true AS same, round(avg(p), 4) AS mean FROM px GROUP BY vec_id",
    "video_scan": f"""WITH {PX}, g AS (SELECT label, rn - 1 AS seq_pos, round(avg(p), 4) AS mean FROM px GROUP BY label, rn), n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
 r AS (SELECT 'sample' AS part, * FROM g WHERE seq_pos % 3 = 0 UNION ALL SELECT 'range', * FROM g WHERE seq_pos >= 10 AND seq_pos < 20)
 SELECT part, CAST(label AS VARCHAR) AS label, seq_pos, 8 AS width, 8 AS height, CAST(n AS INTEGER) AS total_frames, round(n / 30.0, 6) AS duration, mean FROM r JOIN n USING (label)""",
    "sql_frames": f"""WITH {HASH}, {PAIRS.format(on="a.rn + 1 = b.rn")}, ch2 AS (SELECT label, ra, count(*) FILTER (WHERE d > 10) AS n FROM (SELECT label, ra, avg(abs(p - q)) AS d FROM pp GROUP BY label, ra, y // {BLOCK}, x // {BLOCK}) GROUP BY ALL),
 md AS (SELECT label, ra, abs(avg(p) - avg(q)) AS d FROM pp GROUP BY ALL)
 SELECT cmp.vec_id, CAST(bit_count(xor(a.hv, b.hv)) AS INTEGER) AS distance, a.hv = b.hv AS match_0, bit_count(xor(a.hv, b.hv)) <= 2 AS match_2, round(s, 4) AS ssim_score, CAST(cmp.n AS INTEGER) AS n_changed, {MAG.replace(" n > ", " cmp.n > ")} AS change_magnitude, round(md.d, 4) AS mean_diff,
 CASE WHEN cmp.n > 0 THEN 4 END AS first_area FROM cmp JOIN h a ON a.label = cmp.label AND a.rn = cmp.ra JOIN h b ON b.vec_id = cmp.vec_id JOIN md ON md.label = cmp.label AND md.ra = cmp.ra""",
    "sql_transcripts": f"""WITH q AS (SELECT conv_id, turn, "start", "end", text FROM ({CUES.replace("SELECT conv_id,", "SELECT conv_id, turn,")})), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seg_pos FROM q)
 SELECT conv_id, kind, CAST(seg_pos AS INTEGER) AS seg_pos, "start", "end", text, {" OR ".join(f"regexp_matches(text, {_sql(r)})" for _, r in BUILTIN)} AS has_pii, md5({_redacted('text')}) AS redacted_md5,
 CAST({" + ".join(f"len(regexp_extract_all(text, {_sql(r)}))" for _, r in BUILTIN)} AS INTEGER) AS n_found FROM f, (VALUES ('srt'), ('vtt')) k(kind)""",
    "pii_spans": "SELECT doc_id, pattern, matched, start, CAST(start + length(matched) AS INTEGER) AS \"end\" FROM (SELECT *, CAST(list_sum(list_transform(pieces[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda s: length(s))), 0) AS INTEGER) AS start, found[i] AS matched FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS pattern, string_split_regex(text, {_sql(r)}) AS pieces, regexp_extract_all(text, {_sql(r)}) AS found, unnest(range(1, len(found) + 1)) AS i FROM documents" for n, r in BUILTIN)
    + "))",
    "metadata_attach": f"""WITH {E} SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN 'app' || vec_id % 5 END AS side_app, CAST(NULL AS VARCHAR) AS side_title, CASE WHEN vec_id % 7 <> 0 THEN 1700000000 + vec_id END AS seconds,
 'site' || label AS app_name, 'do ' || label AS window_title, CASE WHEN rn BETWEEN 2 AND 21 THEN 'op' || lag(vec_id) OVER (PARTITION BY label ORDER BY rn) END AS action FROM e""",
    "missing_pictures": masked_walk("label", 0.6)
    + """SELECT CASE WHEN vec_id % 5 = 0 THEN 'missing' ELSE 'there' END AS what, vec_id FROM ca WHERE is_kf UNION ALL SELECT 'unknown', vec_id FROM ca WHERE vec_id % 11 = 0""",
    "result_documents": masked_walk("label", 0.6)
    + f""", m2 AS (SELECT vec_id, list({{'x': CAST(c * 2 AS INTEGER), 'y': CAST(r * 2 AS INTEGER), 'w': 2, 'h': 2}} ORDER BY r, c) AS regions_ FROM mk WHERE noisy GROUP BY vec_id),
 fd AS (SELECT label, list({{'frame_id': CAST(vec_id AS VARCHAR), 'event_type': CASE WHEN is_kf THEN 'KEYFRAME' ELSE 'SKIPPED' END, 'is_keyframe': is_kf, 'perceptual_hash': {HEX.format('hv[1]')}, 'adaptive_mask': regions_, 'prev_keyframe_id': CAST(before_id AS VARCHAR)}} ORDER BY rn) AS frames FROM ca LEFT JOIN m2 USING (vec_id) GROUP BY label),
 ru AS (SELECT CAST(label AS VARCHAR) AS task_id, label, grouping(label) AS g, count(*) AS num_frames, count(*) FILTER (WHERE is_kf) AS num_keyframes, round(1 - count(*) FILTER (WHERE is_kf) / count(*), 6) AS skip_rate FROM ca GROUP BY ROLLUP (label))
 SELECT task_id AS seq_id, CAST(to_json({{'task_id': task_id, 'num_frames': num_frames, 'num_keyframes': num_keyframes, 'skip_rate': skip_rate, 'frames': frames}}) AS VARCHAR) AS document FROM ru JOIN fd USING (label) WHERE g = 0
 UNION ALL SELECT NULL, CAST(to_json({{'tasks': (SELECT list({{'task_id': task_id, 'num_frames': num_frames, 'num_keyframes': num_keyframes, 'skip_rate': skip_rate}} ORDER BY task_id) FROM ru WHERE g = 0), 'total_frames': num_frames, 'total_keyframes': num_keyframes, 'total_skip_rate': skip_rate}}) AS VARCHAR) FROM ru WHERE g = 1""",
    "cascade_tall": masked_walk("label", 0.6, 2 * SIDE, 28)
    + f"SELECT vec_id, is_kf AS is_keyframe, round(s, 4) AS ssim_score, regions AS changed_regions, masks AS adaptive_mask, CAST(before_id AS VARCHAR) AS prev_keyframe_id, {REASON.replace('16.0', '32.0').replace('14', '28')} AS visual_reason, {HEX.format('hv[1]')} AS perceptual_hash FROM ca",
    "manifest_rows": masked_walk("label", 0.6)
    + f"""SELECT CAST(vec_id AS VARCHAR) AS frame_id, CAST(NULL AS TIMESTAMP) AS timestamp, CASE WHEN is_kf THEN 'KEYFRAME' ELSE 'SKIPPED' END AS event_type, CAST(NULL AS VARCHAR) AS app_name, CAST(NULL AS VARCHAR) AS window_title,
 is_kf AS is_keyframe, {HEX.format('hv[1]')} AS perceptual_hash, round(s, 4) AS ssim_score, round(1 - s, 4) AS change_score, round(n / 16.0 * 100, 4) AS changed_pct, regions AS changed_regions, masks AS adaptive_mask, 8 AS frame_width, 8 AS frame_height,
 CAST(NULL AS VARCHAR) AS source_format, CASE WHEN is_kf THEN './output/' || vec_id || '.png' END AS asset_path, CAST(NULL AS BOOLEAN) AS pii_detected, {REASON} AS visual_reason, CAST(before_id AS VARCHAR) AS prev_keyframe_id, './output/' || before_id || '.png' AS prev_keyframe_path,
 CAST(NULL AS VARCHAR) AS source_video, CAST(NULL AS DOUBLE) AS video_timestamp, CAST(NULL AS INTEGER) AS video_frame_number, CAST(NULL AS DOUBLE) AS time_since_prev_keyframe, CAST(NULL AS VARCHAR) AS audio_activity, CAST(NULL AS VARCHAR) AS transcript_segment,
 CAST(NULL AS INTEGER) AS keyframe_index, CAST(NULL AS INTEGER) AS total_keyframes, CAST(NULL AS DOUBLE) AS video_duration, CAST(NULL AS VARCHAR) AS change_magnitude FROM ca""",
}
