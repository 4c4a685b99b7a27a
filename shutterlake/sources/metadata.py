"""What probes and EXIF readers say of a file (JSON), as columns of a media row. JSON that can't be read gives nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.times import exif_ms, iso_ms

_PROBE = """format STRUCT<duration STRING, tags STRUCT<creation_time STRING, `com.apple.quicktime.creationdate` STRING, location STRING>>,
streams ARRAY<STRUCT<codec_type STRING, codec_name STRING, width STRING, height STRING, tags STRUCT<rotate STRING, creation_time STRING>, side_data_list ARRAY<STRUCT<rotation STRING>>>>"""
#: Orientations that EXIF readers give as text.
ORIENTATIONS = {
    "Horizontal (normal)": 1, "Mirror horizontal": 2, "Rotate 180": 3, "Mirror vertical": 4,
    "Mirror horizontal and rotate 270 CW": 5, "Rotate 90 CW": 6, "Mirror horizontal and rotate 90 CW": 7, "Rotate 270 CW": 8,
}
#: Names that readers give one value, the first that is given counts.
_ALIASES = {
    "latitude": ["latitude", "GPSLatitude"], "longitude": ["longitude", "GPSLongitude"], "altitude": ["GPSAltitude"],
    "mime": ["MIMEType", "ContentType", "FileTypeMime"],
    "width": ["ExifImageWidth", "PixelXDimension", "ImageWidth", "Width"],
    "height": ["ExifImageHeight", "PixelYDimension", "ImageHeight", "Height"],
}
_TYPES = {"latitude": "double", "longitude": "double", "altitude": "double", "mime": "string", "width": "bigint", "height": "bigint"}


def iso6709(text: Column) -> tuple[Column, Column]:
    """(lat, lng) of a place such as +39.9042+116.4074/."""
    part = lambda k: F.regexp_extract(text, r"^([+-]?\d+\.?\d*)([+-]\d+\.?\d*)", k).try_cast("double")
    return part(1), part(2)


def _whole(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def rotation(stream: Column) -> Column:
    """Degrees of a video stream: its tag, else the first side data that has some, else 0."""
    side = F.filter(F.transform(stream["side_data_list"], lambda x: _whole(x["rotation"])), lambda x: x.isNotNull())
    return F.coalesce(_whole(stream["tags"]["rotate"]), F.get(side, F.lit(0)), F.lit(0))


def shown_size(width: Column, height: Column, degrees: Column) -> tuple[Column, Column]:
    """(width, height) as seen: a quarter turn swaps them."""
    turned = F.pmod(degrees, F.lit(360)).isin(90, 270) & (width > 0) & (height > 0)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def probed(json: Column) -> list[Column]:
    """Columns of a video: duration, codec, coded and shown size, rotation, creation time, place."""
    data = F.from_json(json, _PROBE)
    video = F.get(F.filter(data["streams"], lambda x: x["codec_type"] == "video"), F.lit(0))
    coded, turn = (_whole(video["width"]), _whole(video["height"])), F.when(video.isNotNull(), rotation(video)).otherwise(0)
    shown, tags = shown_size(*coded, turn), data["format"]["tags"]
    lat, lng = iso6709(tags["location"])
    made = F.coalesce(iso_ms(video["tags"]["creation_time"]), iso_ms(F.coalesce(F.nullif(tags["creation_time"], F.lit("")), tags.getField("com.apple.quicktime.creationdate"))))
    named = {"duration": data["format"]["duration"].try_cast("double"), "codec": video["codec_name"], "coded_width": coded[0], "coded_height": coded[1], "rotation": turn, "width": shown[0], "height": shown[1], "created_ms": made, "latitude": lat, "longitude": lng}
    return [c.alias(k) for k, c in named.items()]


def exif(json: Column) -> list[Column]:
    """Columns of an image from what an EXIF reader gives: one name for what readers name apart, orientation as a number, time in
    milliseconds (a text, or an object with the text as rawValue)."""
    # parsed once; an object among the values is its text
    data = F.from_json(json, ", ".join(f"`{n}` STRING" for n in [*(n for names in _ALIASES.values() for n in names), "Orientation", "DateTimeOriginal"]))
    inner = lambda name, key: F.when(data[name].startswith("{"), F.get_json_object(data[name], f"$.{key}"))
    out = [F.coalesce(*(data[n] for n in names)).try_cast(_TYPES[k]).alias(k) for k, names in _ALIASES.items()]
    texts = F.create_map(*(F.lit(x) for kv in ORIENTATIONS.items() for x in kv))
    turn = F.coalesce(inner("Orientation", "value").try_cast("int"), data["Orientation"].try_cast("int"), F.try_element_at(texts, F.coalesce(data["Orientation"], F.lit(""))))
    return [*out, turn.alias("orientation"), exif_ms(F.coalesce(inner("DateTimeOriginal", "rawValue"), data["DateTimeOriginal"])).alias("captured_ms")]
