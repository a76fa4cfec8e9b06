"""Render plans as text; nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspan.functions.text import escape_filter_path

# Filter texts by profile.
CROP = "min(iw\\,ih*9/16):min(ih\\,iw*16/9)"
ZOOM = f"scale=iw*1.15:ih*1.15,crop={CROP}"
CROP_BIAS = {"left": "0", "center": "(iw-ow)/2", "right": "iw-ow"}
FACECAM = {"width_ratio": 0.25, "height_ratio": 0.35, "x_ratio": 0.75, "y_ratio": 0.65}
SCALE = "scale=608:1080"
BACKDROP = "[0:v]scale=608:1080:force_original_aspect_ratio=increase,crop=608:1080,gblur=sigma=20[bg];[0:v]scale=608:-2[fg];[bg][fg]overlay=(W-w)/2:(H-h)/2[base];"
FACECAM_CROP = ("[0:v]crop=iw*", ":ih*", ":iw*", ":ih*")
FACECAM_LAYER = ",scale=182:-2[cam];[base][cam]overlay=W-w-20:H-h-20[vout]"
IRL_COLOUR = "eq=contrast=1.05:saturation=1.15"
ENCODE = "-c:v h264_videotoolbox -b:v 8M"
MIX = "[m];[0:a][m]amix=inputs=2:duration=first:dropout_transition=0[aout]"
VOLUMES = {"podcast": 0.12, "irl": 0.15}
PROFILES = ("podcast", "interview", "gaming", "irl", "default")
SILENT_CAPTIONS = ("gaming", "irl")


def profile(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit("default"))))
    return F.when(low.isin(*PROFILES), low).otherwise("default")


def should_caption(name: Column) -> Column:
    return ~F.lower(F.coalesce(name, F.lit(""))).isin(*SILENT_CAPTIONS)


def music_volume(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in VOLUMES.items() for x in kv]), F.lower(F.coalesce(name, F.lit(""))))


def facecam_crop(region: Column | None = None) -> Column:
    """The crop of the face camera by a struct of ratios of the source's size (width_ratio, height_ratio, x_ratio, y_ratio);
    the default where there is no struct, or for a ratio that is null."""
    ratio = lambda k: F.lit(FACECAM[k]) if region is None else F.coalesce(region[k].cast("double"), F.lit(FACECAM[k]))
    return F.concat(*[x for head, k in zip(FACECAM_CROP, FACECAM, strict=True) for x in (F.lit(head), ratio(k).cast("string"))])


def filter_args(name: Column, bias: Column, facecam: Column | None = None) -> Column:
    """The video filter of a clip as one argument text; ``facecam`` is the region of ``facecam_crop``."""
    p = profile(name)
    x = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in CROP_BIAS.items() for v in kv]), F.coalesce(bias, F.lit("center"))), F.lit(CROP_BIAS["center"]))
    layered = F.concat(F.lit(f"-filter_complex {BACKDROP}"), facecam_crop(facecam), F.lit(f"{FACECAM_LAYER} -map [vout] -map 0:a?"))
    out = F.when(p == "gaming", layered).when(p == "interview", F.concat(F.lit(f"-vf {ZOOM}:"), x, F.lit(f":0,{SCALE}")))
    return out.when(p == "irl", f"-vf {ZOOM},{SCALE},{IRL_COLOUR}").otherwise(f"-vf {ZOOM},{SCALE}")


def _command(*parts: Column | str) -> Column:
    """The parts in one text; null where one of them is."""
    return F.concat(F.lit("ffmpeg -y"), *[x for p in parts for x in (F.lit(" "), F.lit(p) if isinstance(p, str) else p)])


def trim_command(source: Column, start: Column, end: Column, out: Column, name: Column, bias: Column, facecam: Column | None = None) -> Column:
    """Cut, crop to the profile and encode; null where the end is not after the start."""
    text = _command("-ss", F.format_string("%.3f", start), "-i", source, "-t", F.format_string("%.3f", end - start), filter_args(name, bias, facecam), ENCODE, "-c:a aac", out)
    return F.when(end > start, text)


def burn_filter(srt_path: Column, style: Column) -> Column:
    return F.concat(F.lit("subtitles="), escape_filter_path(srt_path), F.lit(":force_style="), F.replace(style, F.lit(","), F.lit("\\,")))


def burn_command(source: Column, srt_path: Column, style: Column, out: Column) -> Column:
    return _command("-i", source, "-vf", burn_filter(srt_path, style), ENCODE, "-c:a copy", out)


def music_filter(duration: Column, volume: Column) -> Column:
    return F.concat(F.lit("[1:a]atrim=end="), F.format_string("%.3f", duration), F.lit(",volume="), volume.cast("string"), F.lit(MIX))


def music_command(source: Column, track: Column, duration: Column, volume: Column, out: Column) -> Column:
    """Loop a track under the clip's sound; null where the profile has no music."""
    text = _command("-i", source, "-stream_loop -1 -i", track, "-filter_complex", music_filter(duration, volume), "-map 0:v -c:v copy -map [aout] -c:a aac", out)
    return F.when(volume.isNotNull(), text)


def trim_length(duration: Column, most: float = 60.0) -> Column:
    """The length that is encoded, null for a source without one."""
    return F.when(duration > 0, F.least(duration, F.lit(most)))


def render_plan(clips: DataFrame, style: str = "Bold=1,Outline=2") -> DataFrame:
    """clips(job_id, clip_no, start_s, end_s, profile, and crop_bias and facecam_region if there are such) with the names, steps and commands of each clip."""
    p, bias = profile(F.col("profile")), F.col("_bias")
    name = lambda kind: F.concat(F.lit("clip_"), F.col("clip_no").cast("string"), F.lit(f"_{kind}.mp4"))
    rows = clips.select("job_id", "clip_no", p.alias("profile"), name("edited").alias("edited"), name("captioned").alias("captioned"), name("final").alias("final"), "start_s", "end_s", (F.col("crop_bias") if "crop_bias" in clips.columns else F.lit(None).cast("string")).alias("_bias"), *([F.col("facecam_region").alias("_cam")] if "facecam_region" in clips.columns else []))
    cam = F.col("_cam") if "_cam" in rows.columns else None
    vol, length = music_volume(F.col("profile")), F.col("end_s") - F.col("start_s")
    captions = should_caption(F.col("profile"))
    shown = F.when(captions, F.col("captioned")).otherwise(F.col("edited"))
    trim = trim_command(F.lit("raw.mp4"), F.col("start_s"), F.col("end_s"), F.col("edited"), F.col("profile"), bias, cam)
    burn = F.when(captions, burn_command(F.col("edited"), F.concat(F.lit("clip_"), F.col("clip_no").cast("string"), F.lit(".srt")), F.lit(style), F.col("captioned")))
    mix = music_command(shown, F.concat(F.col("profile"), F.lit(".mp3")), length, vol, F.col("final"))
    return rows.select("*", captions.alias("captions"), vol.isNotNull().alias("music"), trim.alias("trim"), burn.alias("burn"), mix.alias("mix"), trim_length(length).alias("length")).drop("_bias", "_cam")


def crop_geometry(sizes: DataFrame) -> DataFrame:
    """sizes(w, h) with the crop to 9:16, truncated to whole pixels."""
    w, h, target = F.col("w"), F.col("h"), F.lit(9.0 / 16.0)
    same = F.abs(w / h - target) <= 0.02
    cw, ch = (h * target).cast("int"), F.least((w / target).cast("int"), h.cast("int"))
    tall = cw > w
    width = F.when(same | tall, w.cast("int")).otherwise(cw)
    height = F.when(same | ~tall, h.cast("int")).otherwise(ch)
    half = lambda a, b: F.greatest(F.lit(0), F.floor((a - b) / 2)).cast("int")
    return sizes.select("*", (~same).alias("crops"), width.alias("crop_w"), height.alias("crop_h"), half(w, width).alias("crop_x"), half(h, height).alias("crop_y"))


def bitrate_ladder(first_kbps: int = 4000, floor_kbps: int = 500, attempts: int = 3) -> list[int]:
    return [max(floor_kbps, first_kbps >> k) for k in range(attempts)]


def encode_attempt(size_mb_at_first: Column, limit_mb: float) -> Column:
    """The first attempt whose size, in proportion to its bitrate, fits; the last one otherwise."""
    ladder = bitrate_ladder()
    out = F.lit(len(ladder))
    for k in range(len(ladder), 0, -1):
        out = F.when(size_mb_at_first * ladder[k - 1] / ladder[0] <= limit_mb, k).otherwise(out)
    return out
