"""DuckDB SQL of the registered queries: what they compute, stated independently of how Spark computes it."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# ---- common table expressions ----------------------------------------------------------------------------------

_FRAMES = """
ev as (select *, cast(json_extract_string(props, '$.k') as int) as k from events),
fr as (
  select concat('DCIM/u', user_id, '/DSC_', lpad(cast(event_id as varchar), 8, '0'), '.JPG') as rel,
    case when k <> 97 then ts end as when_ts, event_id * 1000 + 1024 as size_bytes, event_id::double + 0.25 as mtime,
    k % 4 as face_count, case when k % 4 <> 0 then ((event_id * 37) % 101)::double / 100::double end as eye_score,
    value as sharpness, ((event_id * 13) % 100)::double / 400::double as blown,
    ((event_id * 29) % 100)::double / 300::double as crushed,
    (((event_id * 13) % 100)::double / 400::double > 0.1::double
      or ((event_id * 29) % 100)::double / 300::double > 0.2::double) as exposure_flag,
    event_id, user_id, event_type, k
  from ev)"""

_HASHED = """
hs as (select vec_id, list_sum(list_transform(range(1, 64),
         lambda i: case when embedding[i + 1] > embedding[i] then (1::bigint << (63 - i)::int) else 0 end))::bigint as phash
       from embeddings),
fh as (select fr.*, hs.phash from fr join hs on hs.vec_id = (fr.event_id // 3) % (select count(*) from embeddings))"""

_CHRON = "when_ts nulls last, rel"
_DELTA = "(epoch_us(when_ts) - epoch_us(lag(when_ts) over w)) / 1e6"


def _islands(src: str, brk: str) -> str:
    return f"""(select *, cast(sum(brk) over (order by {_CHRON}) as bigint) as burst_id from (
      select *, case when row_number() over w = 1 then 0 when {brk} then 1 else 0 end as brk
      from {src} window w as (order by {_CHRON})))"""


_TIME = _FRAMES + ",\ng as " + _islands("fr", f"when_ts is null or lag(when_ts) over w is null or {_DELTA} > 300")
_SIM = (
    _FRAMES
    + ","
    + _HASHED
    + ",\ng as "
    + _islands("fh", f"bit_count(xor(phash, lag(phash) over w)) > 30 or coalesce({_DELTA} > 900, false)")
)


def _verdict(source: str = "g", name: str = "v", keep: int = 1) -> str:
    """Verdicts as (name) over the grouped frames (source)."""
    return f""",
{name}_st as (select *, max(sharpness) over (partition by burst_id) as peak, count(*) over (partition by burst_id) as n,
    quantile_cont(case when face_count > 0 then face_count end, 0.5) over (partition by burst_id) as med from {source}),
{name}_f as (select *, coalesce(med >= 2, false) as is_group, n = 1 as is_single,
    (not coalesce(med >= 2, false) and face_count >= 1 and coalesce(eye_score < 0.5, false) and n > 1) as gated from {name}_st),
{name}_r as (select *, row_number() over (partition by burst_id, gated order by
    case when is_group then coalesce(eye_score, 0) else 0 end desc, sharpness desc, {_CHRON}) - 1 as rk from {name}_f),
{name}_b as (select *,
    case when is_single then case when face_count = 1 and coalesce(eye_score < 0.5, false) then 'rejected'
                                  when sharpness < 50 then 'maybe' else 'keeper' end
         when gated then 'rejected' when rk < {keep} then 'keeper'
         when peak > 0 and sharpness < peak * 0.3::double then 'rejected' else 'maybe' end as bin,
    case when is_single then case when face_count = 1 and coalesce(eye_score < 0.5, false) then 'single, eyes closed'
                                  when sharpness < 50 then 'single, sharpness uncertain' else 'single, passed checks' end
         when gated then 'eyes closed' when rk < {keep} then case when is_group then 'best eyes + sharpness' else 'sharpest in burst' end
         when peak > 0 and sharpness < peak * 0.3::double then 'much softer than burst peak' else 'burst runner-up' end as why,
    cast(case when is_single then 0 when gated then -1 else rk end as int) as rank_in_burst from {name}_r),
{name} as (select * , why || case when exposure_flag and bin <> 'rejected' then '; exposure flag' else '' end as reason from {name}_b)"""


_JT = _TIME + _verdict()
_JS = _SIM + _verdict()

_ISO = "(strftime({0}, '%Y-%m-%dT%H:%M:%S') || case when epoch_us({0}) % 1000000 <> 0 then '.' || lpad((epoch_us({0}) % 1000000)::varchar, 6, '0') else '' end)"
_ID = "('p' || substr(sha1(rel), 1, 12))"
_FILE = "split_part(rel, '/', -1)"
_EXPOSURE = "case when not exposure_flag then 'ok' when blown >= crushed then 'blown' else 'crushed' end"
_BEST = f"bin <> 'keeper', sharpness desc, {_CHRON}"

# Frame documents as (d) over verdicts (v).
_DOCS = f""",
d as (select burst_id, row_number() over (partition by burst_id order by {_BEST}) - 1 as position, {_ID} as id, {_FILE} as filename,
    case when pk <= 0 then 0 else greatest(0, least(99, round_even(99.0::double * sharpness / pk, 0)::int)) end as sharpness,
    coalesce(round_even(eye_score * 100, 0)::int, -1) as eyes, face_count as faces, {_EXPOSURE} as exposure, bin as mark, reason, size_bytes,
    rel as rel_path
  from (select v.*, (select max(sharpness) from v) as pk from v))"""

# Bursts as (bt) over verdicts (v), then labels as (bl).
_BURSTS = f""",
bt as (select burst_id, count(*) as n_frames, coalesce(strftime(min(when_ts), '%H:%M:%S'), '--:--:--') as time,
    bool_or(face_count > 0) as faces from v group by burst_id),
kp as (select burst_id, {_ID} as keeper_id from v qualify row_number() over (partition by burst_id order by {_BEST}) = 1),
bl as (select bt.*, kp.keeper_id,
    case when count(*) over (partition by time) = 1 then time
         else time || ' · group ' || row_number() over (partition by time order by burst_id) end as label
  from bt join kp using (burst_id))"""

_FAVOURITES = f""",
fav as (select {_ID} as id from fr where event_type = 'purchase')"""

# Detections as (dt), foreground faces as (fg), frames with faces as (ff).
_FACES = """,
dt as (select rel, face_no, (event_id * 7 + face_no * 31) % 800 as x, (event_id * 11 + face_no * 13) % 500 as y,
    (event_id * 3 + face_no * 17) % 300 + 20 as w, (event_id * 5 + face_no * 17) % 300 + 20 as h,
    0.5::double + ((event_id * 23 + face_no * 7) % 100) / 200::double as confidence,
    coalesce(case when k % 10 <> 3 then ((event_id * 19 + face_no * 41) % 100) / 100::double end, 1::double) as open_prob
  from (select *, unnest(range(1, face_count + 1))::int as face_no from fr where face_count > 0)),
dr as (select *, w * h / (1280 * 853)::double as area, max(w * h / (1280 * 853)::double) over (partition by rel) as big,
    row_number() over (partition by rel order by w * h desc, face_no) as face_rank from dt where confidence >= 0.6::double),
fg as (select rel, face_no, face_rank::int as face_rank, area, open_prob, x / 1280::double as fx, y / 853::double as fy, w / 1280::double as fw, h / 853::double as fh
  from dr where face_rank <= 6 and area >= greatest(0.005::double, 0.6::double * big)),
pb as (select * from fg qualify row_number() over (partition by rel order by fw * fh desc, face_rank) = 1)"""

_REGION = """,
gp as (select g.rel, g.burst_id, pb.fx, pb.fy, pb.fw, pb.fh from g left join pb using (rel)),
lr as (select burst_id, coalesce(quantile_cont(fx, 0.5), 0.25) as x, coalesce(quantile_cont(fy, 0.5), 0.25) as y,
    coalesce(quantile_cont(fw, 0.5), 0.5) as w, coalesce(quantile_cont(fh, 0.5), 0.5) as h from gp group by burst_id)"""


def _round_box(*cols: str) -> str:
    return ", ".join(f"round({src}, 9) as box_{dst}" for src, dst in zip(cols, "xywh"))


_CACHE = """,
cb as (select rel, mtime, size_bytes, event_type, sharpness, eye_score from fr),
ca as (
  select '300.0' as tag, rel, case when event_type = 'purchase' then mtime - 1 else mtime end as mtime, size_bytes, sharpness, eye_score, 1 as wr
    from cb where event_type in ('view', 'click', 'purchase')
  union all select '300.0', rel, mtime, size_bytes, sharpness + 1, eye_score, 2 from cb where event_type = 'click'
  union all select 'sim', rel, mtime, size_bytes, 0::double, eye_score, 3 from cb where event_type = 'view'),
cl as (select tag, rel, mtime, size_bytes, eye_score, sharpness from ca
  qualify row_number() over (partition by tag, rel, mtime, size_bytes order by wr desc) = 1),
ct as (select * from cl where tag = '300.0')"""

_GRID = """
gv as (select vec_id, list_transform(embedding, lambda e: greatest(0, least(255, floor((e::double + 0.6) * 212)::int))) as a from embeddings),
gx as (select vec_id, unnest(range(0, 64)) as i, unnest(a) as val from gv),
gg as (select vec_id, i // 8 as y, i % 8 as x, val from gx)"""


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = (f"with {ctes}\n" if ctes else "") + select


# ---- grouping and verdicts -------------------------------------------------------------------------------------

oracle("time_bursts", _TIME, "select rel, burst_id from g")
oracle("similarity_bursts", _SIM, "select rel, burst_id from g")
oracle("verdicts_time", _JT, "select rel, burst_id, bin, reason, rank_in_burst from v")
oracle("verdicts_similarity", _JS, "select rel, burst_id, bin, reason, rank_in_burst from v")
oracle("burst_rank", _JT, "select rel, gated, rank_in_burst from v")
oracle("burst_peak", _TIME, "select burst_id, max(sharpness) as peak from g group by 1")
oracle(
    "group_shots",
    _TIME,
    "select burst_id, coalesce(quantile_cont(case when face_count > 0 then face_count end, 0.5) >= 2, false) as is_group from g group by 1",
)
_SUMMARY = """(select '{1}' as method, count(*) as groups, count(*) filter (n = 1) as singles, count(*) filter (n > 1) as bursts
  from (select burst_id, count(*) as n from {0} group by 1))"""
oracle(
    "group_summary",
    _SIM + ",\ngt as " + _islands("fr", f"when_ts is null or lag(when_ts) over w is null or {_DELTA} > 300"),
    f"select * from {_SUMMARY.format('gt', 'time')} union all select * from {_SUMMARY.format('g', 'similarity')}",
)
oracle("bin_counts", _JT, "select bin, count(*) as frames from v group by 1")
oracle(
    "top_keepers",
    _TIME + _verdict(),
    "select rel, burst_id, sharpness from v where not gated and rk < 2",
)
oracle("chronological", _FRAMES, f"select rel, row_number() over (order by {_CHRON}) - 1 as position from fr")
oracle("best_first", _JT + _DOCS, "select id, burst_id, position from d")

# ---- scalar columns --------------------------------------------------------------------------------------------

oracle("frame_id", _FRAMES, f"select rel, {_ID} as id, {_FILE} as filename from fr")
oracle(
    "sharpness_display",
    _FRAMES,
    "select rel, greatest(0, least(99, round_even(99.0::double * sharpness / (select max(sharpness) from fr), 0)::int)) as sharpness from fr",
)
oracle("result_peak", _FRAMES, "select max(sharpness) as peak from fr")
oracle("exposure_label", _FRAMES, f"select rel, {_EXPOSURE} as exposure from fr")
oracle("eyes_percent", _FRAMES, "select rel, coalesce(round_even(eye_score * 100, 0)::int, -1) as eyes from fr")
oracle(
    "timecode",
    _FRAMES,
    f"select rel, coalesce(strftime(when_ts, '%H:%M:%S'), '--:--:--') as time, coalesce({_ISO.format('when_ts')}, '') as when_iso from fr",
)
oracle(
    "burst_key",
    _SIM + ",\ngt as " + _islands("fr", f"when_ts is null or lag(when_ts) over w is null or {_DELTA} > 300"),
    "select rel, 't' || burst_id as key from gt union all select rel, 's' || burst_id from g",
)
oracle("eye_gate", _FRAMES, "select rel, coalesce(eye_score < 0.5, false) as fails from fr")
oracle("annotate", _FRAMES, "select rel, event_type || case when exposure_flag then '; exposure flag' else '' end as reason from fr")
oracle(
    "slug",
    "",
    """select doc_id, coalesce(nullif(substr(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', '-', 'g'), '-'), 1, 30), ''), 'x') as slug
from documents""",
)
oracle(
    "display_columns",
    _JT + _DOCS,
    """select id, case mark when 'keeper' then 'Best' when 'maybe' then 'Maybe' else 'Rejected' end as label,
  lpad(sharpness::varchar, 2, '0') as sharpness_text, case when eyes < 0 then '—' else eyes || '%' end as eyes_text,
  case exposure when 'blown' then 'Highlights clipped' when 'crushed' then 'Shadows crushed' else '' end as warning,
  case when sharpness >= 70 then 'green' when sharpness >= 48 then 'amber' else 'red' end as band,
  sharpness / 100::double as fill from d""",
)
oracle(
    "size_and_clock_text",
    _FRAMES,
    """select rel, case when s <= 0 then '0 GB' when s >= 1073741824 then printf('%.1f GB', s / 1073741824::double)
    else printf('%.0f MB', s / 1048576::double) end as size, format('{:,}', s) as grouped,
  (t // 60) || ':' || lpad((t % 60)::varchar, 2, '0') as clock
from (select rel, size_bytes * 997 - 2000000 as s, round(sharpness * 7)::bigint as t from fr)""",
)
oracle(
    "progress_metrics",
    "",
    """select event_id, round(least(1, k / 90::double), 9) as fraction, least(100, round(k / 90::double * 100)::int) as percent,
  case when k > 0 and k < 90 then value / k * (90 - k) else 0 end as remaining
from (select event_id, value, cast(json_extract_string(props, '$.k') as int) as k from events)""",
)
oracle(
    "crop_box",
    _FRAMES + _FACES,
    """select rel, face_no, case when e then 0 else x0 end as x0, case when e then 0 else y0 end as y0,
  case when e then 1280 else x1 end as x1, case when e then 853 else y1 end as y1
from (select *, x1 <= x0 or y1 <= y0 as e from (select rel, face_no, greatest(0, trunc(fx * 1280)::int) as x0, greatest(0, trunc(fy * 853)::int) as y0,
  least(1280, trunc((fx + fw) * 1280)::int) as x1, least(853, trunc((fy + fh) * 853)::int) as y1 from fg))""",
)
oracle(
    "box_text",
    _FRAMES + _FACES,
    """select rel, face_no, text, case when good then split_part(damaged, ';', 1)::double end as box_x,
  case when good then split_part(damaged, ';', 2)::double end as box_y, case when good then split_part(damaged, ';', 3)::double end as box_w,
  case when good then split_part(damaged, ';', 4)::double end as box_h
from (select *, regexp_full_match(damaged, '([0-9]+[.][0-9]+;){3}[0-9]+[.][0-9]+') as good from (
  select *, case when contains(rel, '/u1') then text || ';1' when contains(rel, '/u2') then replace(text, '0.', 'x') else text end as damaged from (
    select rel, face_no, printf('%.5f;%.5f;%.5f;%.5f', x / 1280::double, y / 853::double, w / 1280::double, h / 853::double) as text from dt)))""",
)
oracle(
    "threshold_map",
    "",
    """select event_id, round(greatest(0, least(1, (100 - value / 4) / 100)) * 64)::int as distance,
  round((1 - greatest(0, least(1, floor(value) / 64::double))) * 100, 9) as likeness,
  round(greatest(0, least(1, value / 300)) * 255)::int as blown_value, round(floor(value) / 255::double, 9) as blown_limit
from events""",
)
oracle(
    "capture_time",
    _FRAMES,
    f"""select rel, coalesce({_ISO.format('w')}, '') as when_iso, good as has_subsec from (
  select rel, good, s + to_microseconds(case when good then rpad(sub, 6, '0')::bigint else 0 end) as w from (
    select *, s is not null and coalesce(regexp_full_match(sub, '[0-9]+'), false) as good from (
      select rel, case when k < 10 then null when k >= 20 and k < 22 then null else date_trunc('second', t) end as s,
        case when k < 30 then digits when k < 40 then 'x1' when k < 50 then '' when k < 60 then null else substr(digits, 1, 2) end as sub
      from (select *, coalesce(when_ts, timestamp '2024-02-29 23:59:59') as t, lpad((event_id * 7919 % 1000000)::varchar, 6, '0') as digits from fr))))""",
)
oracle(
    "csv_cells",
    "",
    """select doc_id, case when regexp_matches(text, '[,"\\n]') then '"' || replace(text, '"', '""') || '"' else text end as cell from documents""",
)
oracle(
    "hamming",
    _FRAMES + "," + _HASHED,
    "select a.vec_id, a.phash, bit_count(xor(a.phash, b.phash))::int as distance from hs a join hs b on b.vec_id = a.vec_id + 1",
)

# ---- faces and regions -----------------------------------------------------------------------------------------

oracle("detections_default", _FRAMES + _FACES, "select rel, face_no, open_prob from dt")
oracle(
    "foreground_faces",
    _FRAMES + _FACES,
    f"select rel, face_no, face_rank, round(area, 9) as area, open_prob, {_round_box('fx', 'fy', 'fw', 'fh')} from fg",
)
oracle("primary_box", _FRAMES + _FACES, f"select rel, {_round_box('fx', 'fy', 'fw', 'fh')} from pb")
oracle(
    "eye_open_fraction",
    _FRAMES + _FACES,
    "select rel, round(sum(case when open_prob >= 0.5 then area else 0 end) / sum(area), 9) as eye_score from fg group by rel",
)
oracle("locked_region", _TIME + _FACES + _REGION, f"select burst_id, {_round_box('x', 'y', 'w', 'h')} from lr")
oracle(
    "subject_region_time",
    _TIME + _FACES + _REGION,
    f"select gp.rel, {_round_box('x', 'y', 'w', 'h')} from gp join lr using (burst_id)",
)
oracle(
    "subject_region_similarity",
    _FRAMES + _FACES,
    f"select fr.rel, {_round_box('coalesce(fx, 0.25)', 'coalesce(fy, 0.25)', 'coalesce(fw, 0.5)', 'coalesce(fh, 0.5)')} from fr left join pb using (rel)",
)

# ---- pixels ----------------------------------------------------------------------------------------------------

oracle(
    "exposure_fractions",
    _GRID,
    """select vec_id, blown > 0.1 or crushed > 0.2 as exposure_flag, blown, crushed from (
  select vec_id, avg(case when val >= 200 then 1.0 else 0.0 end)::double as blown, avg(case when val <= 60 then 1.0 else 0.0 end)::double as crushed
  from gg group by 1)""",
)
_LAPLACE = """select vec_id, round(sum(l * l) / n - (sum(l) / n) * (sum(l) / n), 6) as sharpness from (
  select vec_id, count(*) over (partition by vec_id)::double as n,
    coalesce(lag(val) over c, lead(val) over c) + coalesce(lead(val) over c, lag(val) over c)
    + coalesce(lag(val) over r, lead(val) over r) + coalesce(lead(val) over r, lag(val) over r) - 4 * val as l
  from {0} window c as (partition by vec_id, x order by y), r as (partition by vec_id, y order by x)) group by vec_id, n"""
oracle("laplacian_variance", _GRID, _LAPLACE.format("gg"))
oracle(
    "laplacian_variance_center",
    _GRID + ",\ngc as (select * from gg where x between 2 and 5 and y between 2 and 5)",
    _LAPLACE.format("gc"),
)
oracle(
    "laplacian_tiles",
    _GRID + ",\ngc as (select * from gg where x between 2 and 5 and y between 2 and 5)",
    _LAPLACE.format("gc"),
)
# The eight rows shrunk to seven (gs): cubic weights, antialiased, in 22-bit fixed point.
_SHRUNK = """,
wk as (select o, k, abs((k - (o + 0.5::double) * 8 / 7 + 0.5::double) / (8 / 7::double)) as t
  from (select unnest(range(0, 7)) as o) cross join (select unnest(range(0, 8)) as k)
  where k >= greatest(0, trunc((o + 0.5::double) * 8 / 7 - 16 / 7::double + 0.5::double))
    and k < least(8, trunc((o + 0.5::double) * 8 / 7 + 16 / 7::double + 0.5::double))),
wc as (select o, k, case when t < 1 then (1.5::double * t - 2.5::double) * t * t + 1
    when t < 2 then ((-0.5::double * t + 2.5::double) * t - 4) * t + 2 else 0 end as w from wk),
wn as (select o, k, w / sum(w) over (partition by o) as w from wc),
wf as (select o, k, trunc(w * 4194304 + case when w < 0 then -0.5::double else 0.5::double end)::bigint as f from wn),
gs as (select vec_id, o as y, x, greatest(0, least(255, (sum(f * val) + 2097152)::bigint >> 22)) as val
  from gg join wf on wf.k = gg.y group by vec_id, o, x)"""
oracle(
    "dhash",
    _GRID + _SHRUNK,
    """select vec_id, sum(case when b then 1::bigint << (48 - (y * 7 + x))::int else 0 end)::bigint as phash from (
  select vec_id, y, x, lead(val) over (partition by vec_id, y order by x) > val as b from gs) where x < 7 group by 1""",
)
_TONES = """,
ch as (select vec_id, i, val as r, 255 - val as g, val * 7 % 256 as b from gx),
cb as (select vec_id, 'red' as channel, r as t from ch union all select vec_id, 'green', g from ch union all select vec_id, 'blue', b from ch
  union all select vec_id, 'luma', (299 * r + 587 * g + 114 * b) // 1000 from ch),
hb as (select vec_id, channel, (t * 64 // 256)::int as bin, count(*) as n from cb group by all)"""
oracle("tone_histogram", _GRID + _TONES, "select vec_id, channel, bin, n from hb")
oracle(
    "histogram_peaks",
    _GRID + _TONES,
    "select vec_id, max(n) filter (channel <> 'luma') as rgb_peak, max(n) filter (channel = 'luma') as luma_peak from hb group by 1",
)

# ---- manifest --------------------------------------------------------------------------------------------------

_WHEN = f"coalesce({_ISO.format('when_ts')}, '')"
oracle(
    "manifest_cells",
    _JT,
    f"""select rel, {_FILE} as filename, burst_id::varchar as burst_id, {_WHEN} as when_iso, face_count::varchar as face_count,
  coalesce(printf('%.4f', eye_score), '') as eye_score, printf('%.3f', sharpness) as sharpness, exposure_flag::int::varchar as exposure_flag,
  printf('%.4f', blown) as blown_frac, printf('%.4f', crushed) as crushed_frac, bin, reason, rank_in_burst::varchar as rank_in_burst from v""",
)
oracle(
    "manifest_read",
    _JT,
    f"""select rel, {_FILE} as filename, burst_id, {_WHEN} as when_iso, face_count, printf('%.4f', eye_score)::double as eye_score,
  printf('%.3f', sharpness)::double as sharpness, exposure_flag, printf('%.4f', blown)::double as blown_frac,
  printf('%.4f', crushed)::double as crushed_frac, bin, reason, rank_in_burst from v""",
)
oracle(
    "manifest_parse",
    _FRAMES,
    f"""select rel, {_FILE} as filename, case when k < 10 then 0 when k < 20 then 7 else event_id end as burst_id,
  case when k >= 10 then '2024-01-01T00:00:00' else '' end as when_iso, case when k < 30 then 0 else face_count end as face_count,
  eye_score, case when k < 25 then 0 else sharpness end as sharpness, k < 60 as exposure_flag, 0.5::double as blown_frac,
  case when k < 90 then 0 else 0.25 end::double as crushed_frac, event_type as bin, case when k < 5 then '' else 'because' end as reason,
  case when k < 50 then -1 else 0 end as rank_in_burst from fr""",
)
_SIM_TIME = _SIM + ",\ngt as " + _islands("fr", f"when_ts is null or lag(when_ts) over w is null or {_DELTA} > 300") + _verdict("gt", "vt") + _verdict("g", "vs")
oracle(
    "manifest_diff",
    _SIM_TIME
    + f""",
c as (select case event_type when 'signup' then 'moved/' || rel else rel end as rel, bin, face_count, burst_id from vt),
o as (select case event_type when 'error' then 'moved/' || rel else rel end as rel, bin, face_count, burst_id from vs)""",
    """select o.rel, 'bin' as field, o.bin as expected, c.bin as actual from c join o using (rel) where c.bin <> o.bin
union all select o.rel, 'burst_id', o.burst_id::varchar, c.burst_id::varchar from c join o using (rel) where c.burst_id <> o.burst_id
union all select o.rel, 'face_count', o.face_count::varchar, c.face_count::varchar from c join o using (rel) where c.face_count <> o.face_count
union all select rel, 'rel', '', rel from c anti join o using (rel)
union all select rel, 'rel', rel, '' from o anti join c using (rel)""",
)

# ---- cache -----------------------------------------------------------------------------------------------------

oracle("cache_latest", _FRAMES + _CACHE, "select tag, rel, mtime, size_bytes, eye_score, sharpness from cl")
oracle("cache_load", _FRAMES + _CACHE, "select rel, mtime, size_bytes, eye_score, sharpness from ct")
oracle(
    "cache_fill",
    _FRAMES + _CACHE,
    """select fr.rel, ct.rel is not null as cached, ct.sharpness, ct.eye_score
from fr left join ct on ct.rel = fr.rel and ct.mtime = fr.mtime and ct.size_bytes = fr.size_bytes""",
)
oracle("needs_measure", _FRAMES + _CACHE, "select rel from fr anti join ct using (rel, mtime, size_bytes)")
oracle(
    "merge_measurements",
    _FRAMES + _CACHE,
    "select rel, coalesce(ct.sharpness, fr.sharpness) as sharpness from fr left join ct using (rel, mtime, size_bytes)",
)
oracle(
    "cache_stats",
    _FRAMES + _CACHE,
    """select count(*) filter (ct.tag is null) as new, count(ct.tag) as from_cache from fr left join ct using (rel, mtime, size_bytes)""",
)
oracle(
    "sharpness_work",
    _TIME + _FACES + _REGION + _CACHE,
    f"""select gp.rel, burst_id, {_round_box('x', 'y', 'w', 'h')} from gp join lr using (burst_id)
where gp.rel in (select rel from fr anti join ct using (rel, mtime, size_bytes))""",
)

# ---- results ---------------------------------------------------------------------------------------------------

oracle(
    "frame_documents",
    _JT + _DOCS,
    "select burst_id, position, id, filename, sharpness, eyes, faces, exposure, mark, reason, size_bytes, rel_path from d",
)
oracle(
    "result_document",
    _JS + _DOCS + _BURSTS,
    """select burst_id, position,
  case when position > 0 then ',' else case when burst_id = 0 then '{"grouping":"similarity","bursts":[' else ',' end
    || '{"id":"s' || burst_id || '","label":"' || label || '","time":"' || time || '","faces":' || (bl.faces)::varchar
    || ',"keeper_id":"' || keeper_id || '","frames":[' end
  || '{"id":"' || d.id || '","filename":"' || filename || '","sharpness":' || sharpness || ',"eyes":' || case when eyes < 0 then 'null' else eyes::varchar end
  || ',"faces":' || d.faces || ',"exposure":"' || exposure || '","mark":"' || mark || '","reason":"' || reason || '","size_bytes":' || size_bytes
  || ',"rel_path":"' || rel_path || '"}'
  || case when position < n_frames - 1 then '' when burst_id = (select max(burst_id) from bl) then ']}]}' else ']}' end as piece
from d join bl using (burst_id)""",
)
oracle("burst_document", _JT + _BURSTS, "select burst_id, label, time, faces, keeper_id, n_frames from bl")
oracle("burst_labels", _JS + _BURSTS, "select burst_id, label from bl")
oracle("burst_has_faces", _TIME, "select burst_id, bool_or(face_count > 0) as faces from g group by 1")
oracle("burst_time", _TIME, "select burst_id, coalesce(strftime(min(when_ts), '%H:%M:%S'), '--:--:--') as time from g group by 1")
oracle(
    "progress_sequence",
    _JT + _BURSTS,
    f"""select row_number() over (order by burst_id, {_BEST}) as done, count(*) over () as total, {_FILE} as current_frame_name,
  label as current_burst_label, 'scoring' as phase from v join bl using (burst_id)""",
)

oracle(
    "progress_lines",
    _JT + _BURSTS,
    f"""select 'progress' as kind, row_number() over (order by burst_id, {_BEST}) as done, count(*) over () as total, {_FILE} as current_frame_name,
  label as current_burst_label, 'scoring' as phase from v join bl using (burst_id)
union all select 'progress', 0, count(*), '', '', 'loading' from v""",
)

# ---- review ----------------------------------------------------------------------------------------------------

oracle("mark_filter", _JT, "select burst_id, rel from v where bin = 'keeper'")
oracle(
    "visible_frames",
    _JT + _DOCS,
    """select burst_id, id, row_number() over (partition by burst_id order by mark <> 'keeper', sharpness desc, position) - 1 as shown_at
from d where mark = 'maybe'""",
)
oracle("mark_counts", _JT, "select bin as mark, count(*) as frames from v group by 1 union all select 'all', count(*) from v")
oracle(
    "mark_counts_wide",
    _JS,
    """select count(*) as "all", count(*) filter (bin = 'keeper') as keeper, count(*) filter (bin = 'maybe') as maybe,
  count(*) filter (bin = 'rejected') as rejected from v""",
)
oracle("best_count", _JT, "select count(*) filter (bin = 'keeper') as best from v")
_STAGED = f""",
m as (select *, 'IMG_' || substr({_FILE}, 12, 1) || '.JPG' as filename, row_number() over (order by burst_id, {_CHRON}) as line from v),
sr as (select *, case bin when 'keeper' then 'keepers/b' || burst_id || '_' || filename when 'maybe' then 'maybe/b' || burst_id || '/' || filename
    else 'rejected/' || substr(trim(regexp_replace(lower(reason), '[^a-z0-9]+', '-', 'g'), '-'), 1, 30) || '_' || filename end as dest from m)"""
oracle(
    "staging_plan", _JT + _STAGED, "select dest, rel, bin, burst_id from sr qualify row_number() over (partition by dest order by line desc) = 1"
)
oracle("staging_counts", _JT + _STAGED, "select bin, count(*) as links from sr where bin in ('keeper', 'maybe') group by 1")
_CARDS = f""",
cd as (select *, {_FILE} as filename, row_number() over (partition by burst_id order by
    case bin when 'keeper' then 0 when 'maybe' then 1 when 'rejected' then 2 else 9 end, rank_in_burst, {_CHRON}) - 1 as place from v)"""
oracle("contact_order", _JT + _CARDS, "select burst_id, rel, place from cd")
oracle(
    "contact_sheet",
    _JT + _CARDS,
    f"""select burst_id, count(*) over (partition by burst_id) as frames, place, filename, bin,
  count(*) filter (bin = 'keeper') over (partition by burst_id) as keepers, count(*) filter (bin = 'maybe') over (partition by burst_id) as maybes,
  count(*) filter (bin = 'rejected') over (partition by burst_id) as rejects,
  coalesce(first_value({_ISO.format('when_ts')} ignore nulls) over (partition by burst_id order by place rows between unbounded preceding and unbounded following), '') as when_iso
from cd""",
)
oracle(
    "contact_totals",
    _JT,
    """select count(*) as photos, count(distinct burst_id) as bursts, count(*) filter (bin = 'keeper') as keepers,
  count(*) filter (bin = 'maybe') as maybes, count(*) filter (bin = 'rejected') as rejects from v""",
)
_RING = """select {0} {1}, {2}, coalesce(lag({2}) over w, last_value({2}) over (w rows between unbounded preceding and unbounded following)) as prev_{2},
  coalesce(lead({2}) over w, first_value({2}) over (w rows between unbounded preceding and unbounded following)) as next_{2}
from {3} window w as ({4})"""
oracle(
    "frame_step",
    _JT + _DOCS + ",\nsh as (select *, row_number() over (partition by burst_id order by mark <> 'keeper', sharpness desc, position) - 1 as shown_at from d)",
    _RING.format("burst_id,", "shown_at", "id", "sh", "partition by burst_id order by shown_at"),
)
oracle(
    "burst_step",
    _JT + ",\nsh as (select burst_id, row_number() over (order by burst_id) - 1 as place from (select distinct burst_id from v where bin = 'rejected'))",
    _RING.format("", "place", "burst_id", "sh", "order by place"),
)
oracle(
    "keeper_lookup",
    _JT + _DOCS + _BURSTS,
    "select bl.burst_id, filename, mark, sharpness from bl join d on d.burst_id = bl.burst_id and d.id = bl.keeper_id",
)
oracle(
    "compare_groupings",
    _SIM_TIME,
    f"""select {_ID} as id, rel, vt.burst_id as left_burst, vt.bin as left_bin, vs.burst_id as right_burst, vs.bin as right_bin
from vt join vs using (rel) where vt.bin <> vs.bin""",
)
oracle(
    "compare_summary",
    _SIM_TIME,
    """select count(*) filter (vt.bin = 'keeper') as left_best, count(*) filter (vs.bin = 'keeper') as right_best,
  count(*) filter (vt.bin <> vs.bin) as differing from vt join vs using (rel)""",
)

# ---- export ----------------------------------------------------------------------------------------------------

_EXPORT = _JT + _DOCS + _FAVOURITES + ",\nxs as (select *, row_number() over (order by burst_id, position) - 1 as pos from d where id in (select id from fav))"
oracle("export_set", _EXPORT, "select pos, id, filename from xs")
oracle("export_size", _EXPORT, "select sum(size_bytes)::bigint as bytes, (select count(*) from fav) as favourites from xs")
oracle(
    "unique_names",
    "",
    """select pos, filename, case when n = 0 then filename else replace(filename, '.JPG', '-' || n || '.JPG') end as exported_as from (
  select *, row_number() over (partition by filename order by pos) - 1 + on_disk as n from (
    select event_id as pos, 'IMG_' || (event_id % 50) || '.JPG' as filename,
      (event_id % 50 in (select n_nationkey from nation))::int as on_disk from events))""",
)
_OUTCOMES = _EXPORT + f""",
oc as (select xs.*, case when k between 30 and 34 then 'failed' when k >= 20 then 'copied' else 'skipped' end as outcome, k from xs join fr on fr.rel = xs.rel_path),
ox as (select *, case when outcome <> 'copied' then '' when k >= 80 then replace(filename, '.JPG', '-1.JPG') else filename end as exported_as,
  case when outcome = 'failed' then 'disk full' else '' end as message from oc)"""
oracle("export_outcomes", _OUTCOMES, "select pos, rel_path, outcome, exported_as, message from ox")
oracle(
    "export_manifest",
    _OUTCOMES,
    "select pos, rel_path, filename, exported_as, mark, sharpness::varchar as sharpness, 'true' as favourite from ox",
)
oracle(
    "export_report",
    _OUTCOMES,
    """select *, copied || ' copied · ' || skipped || ' skipped (source not found) · ' || failed || ' failed' as summary from (
  select count(*) filter (outcome = 'copied') as copied, count(*) filter (outcome = 'skipped') as skipped, count(*) filter (outcome = 'failed') as failed from ox)""",
)

# ---- sources ---------------------------------------------------------------------------------------------------

oracle(
    "source_stats",
    _FRAMES,
    """select count(*) as photos, sum(size_bytes)::bigint as bytes, count(distinct event_type) as types from fr where event_type <> 'signup'""",
)
_ROUTED = """
ev as (select *, cast(json_extract_string(props, '$.k') as int) as k from events),
ro as (select event_id, user_id, event_type, k, case when event_type in ('view', 'click') then 'progress'
    when event_type = 'purchase' then case when k < 90 then 'result' else 'error' end
    when event_type = 'signup' then 'skipped' when k < 50 then 'error' else 'skipped' end as kind from ev)"""
oracle("route_events", _ROUTED, "select event_id, kind, case when kind = 'progress' then event_id else -1 end as done from ro")

# ---- streaming -------------------------------------------------------------------------------------------------

oracle(
    "progress_stream",
    _ROUTED,
    """select user_id as run, max(event_id) as done, 1000000::bigint as total, 'DSC_' || max(event_id) || '.JPG' as current_frame_name,
  arg_max(case when event_type = 'view' then 'scoring' else '' end, event_id) as phase, count(*) as events
from ro where kind = 'progress' group by user_id""",
)
_LIVE = _FRAMES + """,
ls as (select *, sum(b) over (partition by user_id order by when_ts, rel) as s from (
  select *, case when epoch_us(when_ts) - epoch_us(lag(when_ts) over (partition by user_id order by when_ts, rel)) <= 21600000000 then 0 else 1 end as b
  from fr where when_ts is not null)),
lb as (select user_id, count(*) as frames, min(when_ts) as f, max(when_ts) as l, max(sharpness) as peak,
  arg_max(rel, struct_pack(a := sharpness, b := rel)) as candidate from ls group by user_id, s
  union all select user_id, 1, null, null, sharpness, rel from fr where when_ts is null)"""
_LIVE_COLS = f"user_id, frames, coalesce({_ISO.format('f')}, '') as first_when, coalesce({_ISO.format('l')}, '') as last_when, peak, candidate"
oracle("batch_time_bursts", _LIVE, f"select {_LIVE_COLS} from lb")
oracle("live_time_bursts", _LIVE, f"select {_LIVE_COLS} from lb")
oracle(
    "incremental_measure",
    _FRAMES + _CACHE,
    """select rel, mtime, size_bytes, eye_score, sharpness from ca where tag = '300.0' and wr = 1
union all select rel, mtime, size_bytes, eye_score, sharpness * 2 from fr anti join (select * from ca where tag = '300.0' and wr = 1) using (rel, mtime, size_bytes)""",
)
