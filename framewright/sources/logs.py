"""Readers of tool logs and sidecar files, from lines (rid, line_no, line) or whole files (rid, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.text import clipped, rate
from framewright.operators.events import coalesced

# What the tools' logs and files look like.
NUMBER = r"(-?[0-9.]+)"
PROBE = "streams array<struct<codec_type:string,width:int,height:int,r_frame_rate:string,avg_frame_rate:string,duration:string,nb_frames:string>>, format struct<duration:string>"
PAIRS = "array<array<double>>"
LABELS = "struct<ads:array<array<double>>,deleted:array<array<double>>,confirmed_show:boolean,confirmed_ad_skips:array<double>>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(rid, line_no, line): rid is the file's name; a file is numbered as a whole."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("rid"), "value")
    return whole.select("rid", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def _group(line: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit("")).try_cast("double")


def probe(files: DataFrame) -> DataFrame:
    """Stream metadata from JSON (rid, value): first video stream, with the container's values where it has none."""
    p = files.select("rid", F.from_json("value", PROBE).alias("p"))
    v = p.select("rid", F.get(F.filter("p.streams", lambda s: s["codec_type"] == "video"), F.lit(0)).alias("v"), "p.format")
    some = lambda x: F.nullif(x.try_cast("double"), F.lit(0.0))
    out = v.select(
        "rid", F.col("v.width").alias("width"), F.col("v.height").alias("height"),
        F.coalesce(F.nullif(rate(F.coalesce("v.r_frame_rate", F.lit(""))), F.lit(0.0)), rate(F.coalesce("v.avg_frame_rate", F.lit("")))).alias("fps"),
        F.coalesce(some(F.col("v.duration")), some(F.col("format.duration")), F.lit(0.0)).alias("duration_s"), F.col("v.nb_frames").try_cast("bigint").alias("_n"),
    )
    return out.withColumn("frame_count", F.coalesce(F.nullif("_n", F.lit(0)), F.floor(F.col("duration_s") * F.col("fps") + 0.5))).drop("_n")


def silence(log: DataFrame) -> DataFrame:
    """Silences: an end pairs with the last start before it; an end or start alone is left out."""
    w = Window.partitionBy("rid").orderBy("line_no")
    found = log.select("rid", "line_no", _group(F.col("line"), f"silence_start: {NUMBER}").alias("s"), _group(F.col("line"), f"silence_end: {NUMBER}").alias("e"), _group(F.col("line"), f"silence_duration: {NUMBER}").alias("d"))
    marks = found.where("s IS NOT NULL OR e IS NOT NULL").withColumn("_start", F.lag("s").over(w))
    return marks.where("e IS NOT NULL AND d IS NOT NULL AND _start IS NOT NULL").select("rid", F.col("_start").alias("start_s"), F.col("e").alias("end_s"), F.col("d").alias("duration_s"))


def silence_from_level(seconds: DataFrame, noise_db: float = -30.0, min_s: float = 0.5, hop_s: float = 1.0) -> DataFrame:
    """Silences from loudness rows (rid, idx, rms): runs below the noise level of min_s or more."""
    from framewright.operators.events import black_runs

    return black_runs(seconds.withColumn("black", F.col("rms") < 10 ** (noise_db / 20)), 1 / hop_s, min_s)


def iframes(log: DataFrame) -> DataFrame:
    """(rid, times): key frame times in ascending order; lines without a number are left out."""
    t = log.withColumn("t", F.trim("line").try_cast("double")).where("t IS NOT NULL")
    return t.groupBy("rid").agg(F.sort_array(F.collect_list("t")).alias("times"))


def loudness(log: DataFrame, seconds: DataFrame) -> DataFrame:
    """(rid, sec, level) for each second of seconds (rid, n): the n-th level mapped from -60..0 dB to 0..1.

    An unreadable level is -90 dB; a second without one is 0.5.
    """
    w = Window.partitionBy("rid").orderBy("line_no")
    raw = F.regexp_extract("line", r"RMS_level=(\S+)", 1)
    db = F.coalesce(F.when(raw.rlike("(?i)nan|inf"), None).otherwise(raw.try_cast("double")), F.lit(-90.0))
    got = log.where(F.col("line").contains("RMS_level=")).select("rid", (F.row_number().over(w) - 1).cast("bigint").alias("sec"), clipped((db + 60) / 60, 0.0, 1.0).alias("_l"))
    every = seconds.where("n > 0").select("rid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("sec"))
    return every.join(got, ["rid", "sec"], "left").select("rid", "sec", F.coalesce("_l", F.lit(0.5)).alias("level"))


def uniformity(log: DataFrame, seconds: DataFrame) -> DataFrame:
    """As loudness(), from pairs of YLOW and YHIGH: their distance over 200."""
    w = Window.partitionBy("rid").orderBy("line_no")
    lo, hi = _group(F.col("line"), f"YLOW={NUMBER}"), _group(F.col("line"), f"YHIGH={NUMBER}")
    pair = log.withColumn("_hi", hi).withColumn("_lo", F.last(lo, ignorenulls=True).over(w)).where("_hi IS NOT NULL AND _lo IS NOT NULL")
    got = pair.select("rid", (F.row_number().over(w) - 1).cast("bigint").alias("sec"), clipped((F.col("_hi") - F.col("_lo")) / 200, 0.0, 1.0).alias("_u"))
    every = seconds.where("n > 0").select("rid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("sec"))
    return every.join(got, ["rid", "sec"], "left").select("rid", "sec", F.coalesce("_u", F.lit(0.5)).alias("uniformity"))


def crop_offset(log: DataFrame) -> DataFrame:
    """(rid, y_offset): from the last crop line; below 8 it is 0, else 20 less, and not below 0."""
    y = F.regexp_extract("line", r"crop=\d+:\d+:\d+:(\d+)", 1).try_cast("bigint")
    last = log.withColumn("_y", y).where("_y IS NOT NULL").groupBy("rid").agg(F.max_by("_y", "line_no").alias("_y"))
    return last.select("rid", F.when(F.col("_y") < 8, F.lit(0)).otherwise(F.greatest(F.col("_y") - 20, F.lit(0))).cast("bigint").alias("y_offset"))


def speaker_windows(spark: SparkSession, path: str) -> DataFrame:
    """A speaker CSV; its header is skipped by position, and a bad row is an error."""
    rows = spark.read.csv(path, header=True, enforceSchema=True, schema="time_s double, conf double, flag string", mode="FAILFAST")
    return rows.select("time_s", "conf", F.col("flag").isin("1", "true").alias("has_speech"))


def logo_template(files: DataFrame) -> DataFrame:
    """(rid, x, y): the mask cells of template files (rid, value), in frame coordinates."""
    key = lambda k: F.regexp_extract("value", rf"(?m)^\s*{k}=(-?\d+)", 1).try_cast("int").alias(k)
    head = files.select("rid", *(key(k) for k in ("logoMinX", "logoMaxX", "logoMinY", "logoMaxY")), F.split(F.regexp_extract("value", r"(?s)Combined Logo Mask[^\n]*\n[^\n]*\n(.*)", 1), "\n").alias("rows"))
    cells = head.select("*", F.posexplode("rows").alias("j", "row")).where(F.col("j") < F.col("logoMaxY") - F.col("logoMinY"))
    dots = cells.select("*", F.posexplode(F.split("row", "")).alias("i", "c")).where((F.col("i") < F.col("logoMaxX") - F.col("logoMinX")) & ~F.col("c").isin("", " ", "\r"))
    return dots.select("rid", (F.col("logoMinX") + F.col("i")).cast("bigint").alias("x"), (F.col("logoMinY") + F.col("j")).cast("bigint").alias("y"))


def cutlist(log: DataFrame, min_s: float = 60.0, gap_s: float = 45.0) -> DataFrame:
    """Blocks of another tool's cutlist: frame pairs at the end of lines, over the rate of the FRAMES AT line / 100."""
    fps = log.where(F.col("line").contains("FRAMES AT")).groupBy("rid").agg(F.max_by(F.regexp_extract("line", r"(\d+)\s*$", 1).try_cast("double"), "line_no").alias("_f"))
    pair = log.where(~F.col("line").contains("FRAMES AT")).select("rid", *(F.regexp_extract("line", r"(\d+)\s+(\d+)\s*$", i).try_cast("double").alias(n) for i, n in ((1, "_s"), (2, "_e"))))
    at = pair.where("_s IS NOT NULL").join(fps, "rid", "left").withColumn("_r", F.coalesce(F.nullif("_f", F.lit(0.0)) / 100, F.lit(25.0)))
    blocks = at.select("rid", (F.col("_s") / F.col("_r")).alias("start_s"), (F.col("_e") / F.col("_r")).alias("end_s")).where(F.col("end_s") - F.col("start_s") >= min_s)
    return coalesced(blocks, gap_s)


def labels(files: DataFrame) -> DataFrame:
    """(rid, source, start_s, end_s) from JSON: a list of pairs, or an object with ads and deleted; unreadable is empty."""
    listed = F.from_json("value", PAIRS)
    object_ = F.from_json("value", LABELS)
    both = files.select("rid", F.when(F.ltrim("value").startswith("["), F.struct(listed.alias("ads"), F.lit(None).cast(PAIRS).alias("deleted"))).otherwise(F.struct(object_["ads"].alias("ads"), object_["deleted"].alias("deleted"))).alias("l"))
    part = lambda c, source: both.select("rid", F.lit(source).alias("source"), F.explode(f"l.{c}").alias("p"))
    out = part("ads", "user").unionByName(part("deleted", "deleted"))
    return out.select("rid", "source", F.get("p", F.lit(0)).alias("start_s"), F.get("p", F.lit(1)).alias("end_s")).where("start_s IS NOT NULL AND end_s IS NOT NULL")


def pseudo_labels(files: DataFrame) -> DataFrame:
    """(rid, frame, label) from sidecars with parallel arrays."""
    p = files.select("rid", F.from_json("value", "frames array<bigint>, labels array<int>").alias("p"))
    return p.select("rid", F.explode(F.arrays_zip("p.frames", "p.labels")).alias("z")).select("rid", F.col("z.frames").alias("frame"), F.col("z.labels").alias("label"))


CHANNELS = "channels array<struct<name:string,slug:string>>"
ENTRIES = "entries array<struct<uuid:string,channelname:string,start_real:bigint,start:bigint>>"


def dimensions(channels: DataFrame, entries: DataFrame) -> DataFrame:
    """(uuid, slug, start_s) from JSON documents (value) of channels and of recordings.

    A channel without a name or slug is none; a recording of an unknown channel has the slug '', one without a start 0.
    Unreadable documents are empty.
    """
    c = channels.select(F.explode(F.from_json("value", CHANNELS)["channels"]).alias("c")).select("c.name", "c.slug").where("name <> '' AND slug <> ''").groupBy("name").agg(F.max("slug").alias("slug"))
    e = entries.select(F.explode(F.from_json("value", ENTRIES)["entries"]).alias("e")).select("e.*").where("uuid <> ''")
    start = F.coalesce(F.nullif("start_real", F.lit(0)), "start", F.lit(0))
    joined = e.join(c, F.col("channelname") == F.col("name"), "left")
    return joined.groupBy("uuid").agg(F.coalesce(F.max("slug"), F.lit("")).alias("slug"), F.max(start).alias("start_s"))


def recordings(paths: DataFrame) -> DataFrame:
    """Recordings (uuid, stem) among paths (path): a folder _rec_<uuid> with an index, a plain text file and a cached stream."""
    uuid = F.regexp_extract("path", r"_rec_([^/]+)/", 1)
    name = F.element_at(F.split("path", "/"), -1)
    own = paths.select(uuid.alias("uuid"), name.alias("name")).where("uuid <> ''")
    text = own.where(F.col("name").endswith(".txt") & ~F.col("name").rlike(r"(\.logo|\.cskp|\.tvd|\.trained\.logo)\.txt$")).groupBy("uuid").agg(F.regexp_replace(F.min("name"), r"\.txt$", "").alias("stem"))
    streams = paths.select(F.regexp_extract("path", r"([^/]+)\.ts$", 1).alias("uuid")).where("uuid <> ''")
    return text.join(own.where("name = 'index.m3u8'"), "uuid", "left_semi").join(streams, "uuid", "left_semi").orderBy("uuid")
