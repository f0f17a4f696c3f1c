"""Column expressions: the scalar vocabulary of the engine, all evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstselect.params import CENTER_BOX, LUMA_MAX, PHASH_BITS

# Texts and limits of the display vocabulary.
UNDATED = "--:--:--"
EXPOSURE_SUFFIX = "; exposure flag"
MARK_LABELS = {"keeper": "Best", "maybe": "Maybe", "rejected": "Rejected"}
EXPOSURE_WARNINGS = {"blown": "Highlights clipped", "crushed": "Shadows crushed"}
BANDS = {"green": 70, "amber": 48, "red": 0}
SLUG_LENGTH = 30


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- time and bits ---------------------------------------------------------------------------------------------


def seconds_between(earlier: Column, later: Column) -> Column:
    """Difference in seconds as a double with microsecond resolution; null if either side is undated."""
    return (later - earlier).cast("interval second").cast("decimal(20,6)").cast("double")


def as_instant(when) -> Column:
    """A naive time as a timestamp, read as UTC whatever the session's zone (which may skip or repeat an hour)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (_c(when) - epoch).cast("interval second").cast("decimal(20,6)")
    return F.timestamp_micros((seconds * 1000000).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two hashes held in signed 64-bit integers."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column) -> Column:
    """The same for hashes of more than 64 bits, held as arrays of words."""
    bits = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(bits, F.lit(0), lambda acc, n: acc + n)


def iso_time(when) -> Column:
    """ISO 8601 without zone, with six fraction digits only when there is a fraction; null stays null."""
    text = _c(when).cast("string")
    fraction = F.when(F.length(text) > 19, F.concat(F.lit("."), F.rpad(F.substr(text, F.lit(21)), 6, "0"))).otherwise("")
    return F.concat(F.translate(F.substring(text, 1, 19), " ", "T"), fraction)


def timecode(when) -> Column:
    return F.coalesce(F.substring(_c(when).cast("string"), 12, 8), F.lit(UNDATED))


def capture_time(dto, subsec) -> Column:
    """Struct (when_ts, has_subsec) from the two tag strings of a photo.

    The date must read ``YYYY:MM:DD HH:MM:SS`` and be a real date, else the frame is undated. The sub-second tag holds
    the digits after the decimal point; one that is no number leaves the whole second.
    """
    shape = r"^\s*(\d{4}):(\d{1,2}):(\d{1,2})\s+(\d{1,2}):(\d{1,2}):(\d{1,2})\s*$"
    number = [F.regexp_extract(_c(dto), shape, i).try_cast("int") for i in range(1, 7)]
    whole = F.when(
        (number[0] > 0) & (number[5] < 60),
        F.try_make_timestamp_ntz(*number[:5], number[5].cast("decimal(8,6)")),
    )
    raw = _c(subsec)
    digits = F.regexp_replace(raw, r"^\s+|\s+$|_", "")
    good = F.coalesce((F.length(raw) > 0) & digits.rlike(r"^([0-9]+([eE][+-]?[0-9]+)?)?$"), F.lit(False)) & whole.isNotNull()
    micros = F.rint(F.concat(F.lit("0."), digits, F.when(digits == "", "0").otherwise("")).try_cast("double") * 1e6)
    exact = F.when(good, F.timestamp_add("MICROSECOND", micros.cast("bigint"), whole)).otherwise(whole)
    return F.struct(exact.alias("when_ts"), good.alias("has_subsec"))


# ---- identity and display --------------------------------------------------------------------------------------


def basename(rel) -> Column:
    return F.substring_index(_c(rel), "/", -1)


def frame_id(rel) -> Column:
    """Stable id of a photo: depends on its path only, so it survives a regroup."""
    return F.concat(F.lit("p"), F.substring(F.sha1(_c(rel).cast("binary")), 1, 12))


def burst_key(method, burst_id) -> Column:
    return F.concat(F.substring(_c(method), 1, 1), _c(burst_id).cast("string"))


def sharpness_display(raw, peak) -> Column:
    """0..99 relative to the sharpest frame of the whole result, rounded half to even."""
    scaled = F.rint(F.try_divide(F.lit(99.0) * _c(raw), _c(peak)))
    return F.when(_c(peak) <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(99), scaled.cast("int"))))


def eyes_percent(eye) -> Column:
    return F.rint(_c(eye) * 100).cast("int")


def exposure_label(flag, blown, crushed) -> Column:
    return F.when(~_c(flag), "ok").when(_c(blown) >= _c(crushed), "blown").otherwise("crushed")


def exposure_flagged(blown, crushed, params) -> Column:
    return (_c(blown) > params.blown_frac) | (_c(crushed) > params.crushed_frac)


def eye_gate_fails(eye, open_gate: float) -> Column:
    return F.coalesce(_c(eye) < open_gate, F.lit(False))


def annotate(reason: Column, flagged: Column) -> Column:
    return F.when(flagged, F.concat(reason, F.lit(EXPOSURE_SUFFIX))).otherwise(reason)


def slug(text) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, SLUG_LENGTH)
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("x"))


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def mark_label(mark) -> Column:
    return _lookup(_c(mark), MARK_LABELS)


def eyes_text(eyes) -> Column:
    return F.coalesce(F.concat(_c(eyes).cast("string"), F.lit("%")), F.lit("—"))


def exposure_warning(exposure) -> Column:
    """Warning text of a flagged exposure; null when it is fine."""
    return _lookup(_c(exposure), EXPOSURE_WARNINGS)


def sharpness_text(sharpness) -> Column:
    return F.format_string("%02d", _c(sharpness))


def sharpness_band(sharpness) -> Column:
    return F.when(_c(sharpness) >= BANDS["green"], "green").when(_c(sharpness) >= BANDS["amber"], "amber").otherwise("red")


def sharpness_fill(sharpness) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(sharpness) / F.lit(100.0)))


# ---- numbers as text -------------------------------------------------------------------------------------------


def fixed(x, digits: int) -> Column:
    """``x`` with a fixed number of decimals, rounded half to even on its exact binary value as C's printf does.

    Spark's own ``%.3f`` rounds the shortest decimal form half up, which differs for values such as 0.0625. The product
    with the power of ten is carried as an exact sum of two doubles; it holds up to 2**52 / 10**digits.
    """
    x = _c(x).cast("double")
    scale = float(10**digits)
    a = F.abs(x)
    spread = a * 134217729.0
    high = spread - (spread - a)
    product = a * scale
    error = (high * scale - product) + (a - high) * scale
    floor = F.floor(product)
    over = product - floor - 0.5
    odd = (floor % 2) == 1
    units = floor + F.when((over > -error) | ((over == -error) & odd), 1).otherwise(0)
    sign = F.when((x < 0) & (units > 0), "-").otherwise("")
    if digits == 0:
        text = F.concat(sign, units.cast("string"))
    else:
        ten = 10**digits
        text = F.concat(
            sign, F.floor(units / ten).cast("string"), F.lit("."), F.lpad((units % ten).cast("string"), digits, "0")
        )
    return F.when(a < 2.0**52 / scale, text).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def grouped_int(n) -> Column:
    return F.format_number(_c(n), 0)


def human_size(size) -> Column:
    b = _c(size)
    gb, mb = b / F.lit(1073741824.0), b / F.lit(1048576.0)
    return F.when(b <= 0, "0 GB").when(gb >= 1, F.concat(fixed(gb, 1), F.lit(" GB"))).otherwise(F.concat(fixed(mb, 0), F.lit(" MB")))


def clock(seconds) -> Column:
    """``M:SS`` of a duration, rounded half away from zero, never negative."""
    total = F.greatest(F.lit(0), F.round(_c(seconds), 0).cast("bigint"))
    return F.concat(F.floor(total / 60).cast("string"), F.lit(":"), F.lpad((total % 60).cast("string"), 2, "0"))


def csv_escape(field) -> Column:
    f = _c(field)
    quoted = F.concat(F.lit('"'), F.replace(f, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(f.rlike('[,"\n]'), quoted).otherwise(f)


# ---- boxes -----------------------------------------------------------------------------------------------------


def box(x, y, w, h) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"), _c(w).alias("w"), _c(h).alias("h"))


def center_box() -> Column:
    return box(*[F.lit(v) for v in CENTER_BOX])


def box_encode(b) -> Column:
    """``x;y;w;h`` with five decimals; empty for no box."""
    b = _c(b)
    return F.when(b.isNull(), "").otherwise(F.concat_ws(";", *[fixed(b[k], 5) for k in "xywh"]))


def box_decode(text) -> Column:
    """The box of ``x;y;w;h``; null unless it is exactly four numbers."""
    part = F.split(_c(text), ";")
    value = [F.trim(F.get(part, i)).try_cast("double") for i in range(4)]
    good = F.size(part) == 4
    for v in value:
        good = good & v.isNotNull()
    return F.when(good, box(*value))


def crop_box(height, width, b) -> Column:
    """Pixel rectangle (x0, y0, x1, y1) of a normalised box, cut to the image; the whole image if that is empty."""
    h, w, b = _c(height), _c(width), _c(b)

    def pixel(v: Column) -> Column:
        return v.cast("int")

    x0, y0 = F.greatest(F.lit(0), pixel(b["x"] * w)), F.greatest(F.lit(0), pixel(b["y"] * h))
    x1, y1 = F.least(w, pixel((b["x"] + b["w"]) * w)), F.least(h, pixel((b["y"] + b["h"]) * h))
    whole = b.isNull() | (x1 <= x0) | (y1 <= y0)
    zero = F.lit(0)
    return F.struct(
        F.when(whole, zero).otherwise(x0).alias("x0"),
        F.when(whole, zero).otherwise(y0).alias("y0"),
        F.when(whole, w).otherwise(x1).alias("x1"),
        F.when(whole, h).otherwise(y1).alias("y1"),
    )


# ---- thresholds of the interactive front end --------------------------------------------------------------------


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def sim_distance(likeness) -> Column:
    return F.floor(_unit((F.lit(100.0) - _c(likeness)) / 100.0) * float(PHASH_BITS) + 0.5).cast("int")


def likeness(distance) -> Column:
    return (F.lit(1.0) - _unit(_c(distance) / F.lit(float(PHASH_BITS)))) * 100.0


def blown_value(limit) -> Column:
    return F.floor(_unit(_c(limit)) * float(LUMA_MAX) + 0.5).cast("int")


def blown_limit(value) -> Column:
    return _c(value) / F.lit(float(LUMA_MAX))


# ---- progress --------------------------------------------------------------------------------------------------


def progress_metrics(done, total, elapsed) -> Column:
    """Struct of fraction, whole percent and remaining seconds of a running pass."""
    d, t, e = _c(done).cast("double"), _c(total), _c(elapsed)
    fraction = F.when(t > 0, _unit(F.try_divide(d, t.cast("double")))).otherwise(F.lit(0.0))
    percent = F.when(
        t > 0, F.least(F.lit(100), F.greatest(F.lit(0), F.round(F.try_divide(d, t.cast("double")) * 100, 0).cast("int")))
    ).otherwise(F.lit(0))
    remaining = F.when((d > 0) & (fraction < 1), F.try_divide(e, d) * (t.cast("double") - d)).otherwise(F.lit(0.0))
    return F.struct(fraction.alias("fraction"), percent.alias("percent"), remaining.alias("remaining"))
