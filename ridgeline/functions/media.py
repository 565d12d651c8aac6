"""Names, container fields and picture geometry as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.numbers import even, half_even

TARGET_W, TARGET_H, MAX_ROTATE = 1080, 1920, 25.0
VIDEO_SUFFIXES = ("mp4", "mov", "mkv", "m4v", "360")


def ride_chapter(name: Column) -> Column:
    """struct(ride, chapter): chaptered names G[XHP]ccrrrr, single-file names GOPRrrrr are chapter 1; else nulls."""
    modern, legacy = r"(?i)^G[XHP](\d{2})(\d{4})(?:\.[^.]*)?$", r"(?i)^GOPR(\d{4})(?:\.[^.]*)?$"
    m = F.regexp_extract(name, modern, 1)
    ride = F.coalesce(F.nullif(F.regexp_extract(name, modern, 2), F.lit("")), F.nullif(F.regexp_extract(name, legacy, 1), F.lit("")))
    chapter = F.when(m != "", F.try_to_number(m, F.lit("99")).cast("int")).when(ride.isNotNull(), F.lit(1))
    return F.struct(ride.alias("ride"), chapter.alias("chapter"))


def aspect_label(w: Column, h: Column) -> Column:
    """8:7, 16:9, 4:3 or 9:16 within 0.02 of the ratio, else the ratio itself."""
    r = F.try_divide(w.cast("double"), h.cast("double"))
    out = F.when(F.coalesce(r, F.lit(0.0)) == 0, F.lit("unknown"))
    for label, x in (("8:7", 8 / 7), ("16:9", 16 / 9), ("4:3", 4 / 3), ("9:16", 9 / 16)):
        out = out.when(F.abs(r - x) < 0.02, F.lit(label))
    return out.otherwise(F.concat(F.format_string("%.2f", r), F.lit(":1")))


def bit_depth(pix_fmt: Column) -> Column:
    ten = F.contains(pix_fmt, F.lit("p10")) | F.contains(pix_fmt, F.lit("10le")) | F.contains(pix_fmt, F.lit("10be"))
    return F.when(ten, 10).when(F.contains(pix_fmt, F.lit("p12")), 12).otherwise(8)


def crop_box(w: Column, h: Column) -> Column:
    """struct(cw, ch, x, y): the centred 9:16 window of a frame, with even sides."""
    wide = w * TARGET_H > h * TARGET_W
    cw = F.when(wide, half_even(h * TARGET_W / F.lit(TARGET_H))).otherwise(w)
    ch = F.when(wide, h).otherwise(half_even(w * TARGET_H / F.lit(TARGET_W)))
    cw, ch = F.least(w, even(cw)).cast("long"), F.least(h, even(ch)).cast("long")
    return F.struct(cw.alias("cw"), ch.alias("ch"), F.floor((w - cw) / 2).alias("x"), F.floor((h - ch) / 2).alias("y"))


def safe_scale(cw: Column, ch: Column, w: Column, h: Column, degrees: Column) -> Column:
    """How much a crop must shrink so that turning the frame shows no corner."""
    a = F.radians(F.least(F.abs(degrees), F.lit(MAX_ROTATE)))
    need_h = cw / 2 * F.sin(a) + ch / 2 * F.cos(a)
    need_w = cw / 2 * F.cos(a) + ch / 2 * F.sin(a)
    return F.when(degrees <= 0.01, F.lit(1.0)).otherwise(F.least(F.lit(1.0), h / 2 / need_h, w / 2 / need_w))


def rotation_budget(cw: Column, ch: Column, w: Column, h: Column) -> Column:
    """The largest turn whose shrunken crop still has the target width: 24 bisection steps as a fold."""
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(MAX_ROTATE).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        fits = F.floor(cw * safe_scale(cw, ch, w, h, mid)) >= TARGET_W
        return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(24)), zero, step, lambda s: s["lo"])


def plan_fps(rates: Column, slowest: bool = False, ceiling: float = 60.0) -> Column:
    """One rate for clips to be joined: null if they agree, else the fastest up to the ceiling, or the slowest."""
    have = F.array_sort(F.array_distinct(F.transform(F.filter(rates, lambda r: r > 0), lambda r: F.round(r, 3))))
    pick = F.array_min(have) if slowest else F.least(F.array_max(have), F.lit(ceiling))
    return F.when(F.size(have) >= 2, pick)


def slugify(text: Column, default: str = "cut", most: int = 60) -> Column:
    """A file name: other characters become one underscore, ends trimmed, 60 characters at most."""
    s = F.btrim(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit(default))


def human_bytes(n: Column) -> Column:
    out = F.format_string("%.1f TB", n / 1e12)
    for unit, size in (("GB", 1e9), ("MB", 1e6), ("kB", 1e3)):
        out = F.when(n < size * 1000, F.format_string(f"%.1f {unit}", n / size)).otherwise(out)
    return F.when(n < 1000, F.format_string("%d B", n.cast("long"))).otherwise(out)


def parse_rate(rate: Column) -> Column:
    """num/den or a plain number as a double; null if it can't be read."""
    den = F.coalesce(F.nullif(F.split_part(rate, F.lit("/"), F.lit(2)), F.lit("")), F.lit("1"))
    return F.try_divide(F.expr("double(1)") * F.split_part(rate, F.lit("/"), F.lit(1)).try_cast("double"), den.try_cast("double"))


def shape_label(w: Column, h: Column) -> Column:
    return F.when(F.try_divide(w.cast("double"), h.cast("double")) > 1.5, F.lit("wide")).otherwise(F.lit("tall"))


def box_remap(box: dict[str, Column], x: Column, y: Column, w: Column, h: Column) -> Column:
    """A tile's box in fractions of the frame; the tile covers (x, y, w, h) of it."""
    return F.struct((x + box["x0"] * w).alias("x0"), (y + box["y0"] * h).alias("y0"), (x + box["x1"] * w).alias("x1"), (y + box["y1"] * h).alias("y1"))


def orientation_delta(wanted: Column, container: Column) -> Column:
    return F.pmod(wanted - F.coalesce(container, F.lit(0)), F.lit(360))


def probe_fields(probe_json: Column) -> Column:
    """The fields of a container probe's JSON text: format, first video stream, telemetry stream."""
    schema = (
        "format struct<format_name:string,duration:string,size:string,bit_rate:string,tags:map<string,string>>,"
        "streams array<struct<codec_type:string,codec_name:string,codec_tag_string:string,width:int,height:int,r_frame_rate:string,pix_fmt:string,"
        "tags:map<string,string>,side_data_list:array<struct<rotation:int>>>>"
    )
    p = F.from_json(probe_json, schema)
    video = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    return F.struct(
        p["format"]["format_name"].alias("container"),
        p["format"]["duration"].try_cast("double").alias("duration_s"),
        p["format"]["size"].try_cast("long").alias("bytes"),
        p["format"]["bit_rate"].try_cast("long").alias("bitrate_bps"),
        F.try_element_at(p["format"]["tags"], F.lit("creation_time")).try_cast("timestamp").alias("recorded_at"),
        video["codec_name"].alias("vcodec"),
        video["width"].alias("width"),
        video["height"].alias("height"),
        aspect_label(video["width"], video["height"]).alias("aspect"),
        parse_rate(video["r_frame_rate"]).alias("fps"),
        video["pix_fmt"].alias("pix_fmt"),
        bit_depth(video["pix_fmt"]).alias("bit_depth"),
        F.coalesce(F.get(video["side_data_list"], F.lit(0))["rotation"], F.lit(0)).alias("rotation"),
        F.exists(p["streams"], lambda s: s["codec_tag_string"] == "gpmd").alias("has_gpmd"),
    )
