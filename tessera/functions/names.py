"""Names and labels: scenes, frames, recordings, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of file names and misspelt class names of public datasets.
SCENE = r"^([^_]+(?:_[^_]+)*?)(?:__\d+__.*)?$"
POSE = r"(\d+)m_(\d+)c"
CLASS_ALIASES = {"feright car": "freight car", "feright": "freight car", "truvk": "truck"}


def scene_of_crop(name: Column) -> Column:
    """The scene of a crop's file name: no folder, no last extension, no window suffix."""
    base = F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    return F.regexp_extract(base, SCENE, 1)


def filled_scene(scene: Column, image: Column) -> Column:
    """An explicit scene wins; a missing or empty one comes from the image."""
    return F.coalesce(F.nullif(scene, F.lit("")), scene_of_crop(image))


def pose(name: Column) -> Column:
    """altitude and angle out of a name, 'unknown' where there is none."""
    found = F.regexp_extract(name, POSE, 0)
    return F.when(found == "", "unknown").otherwise(found)


def altitude(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, POSE, 1), F.lit("")).cast("int")


def class_name(name: Column) -> Column:
    """Lower case, trimmed, known misspellings mended."""
    low = F.lower(F.trim(name))
    out = low
    for wrong, right in CLASS_ALIASES.items():
        out = F.when(low == wrong, F.lit(right)).otherwise(out)
    return out


def frame_number(name: Column) -> Column:
    return F.nullif(F.regexp_replace(name, r"\D", ""), F.lit("")).cast("bigint")


def dataset_scene(dataset: Column, image: Column) -> Column:
    """The scene rule of each dataset; null where none is defined or the name does not follow it."""
    found = lambda pattern: F.nullif(F.regexp_extract(image, pattern, 1), F.lit(""))
    dota, codrone = found(r"^(P[0-9]+)(?:__.*)?$"), found(r"^(.+_(?:day|night|dusk|dawn)_[0-9]+m_[0-9]+c)_frame_[0-9]+(?:__.*)?$")
    return F.when(dataset == "dota", dota).when(dataset == "codrone", codrone).when(dataset.isin("rsar", "dv", "hrsid"), F.lit(None).cast("string")).otherwise(image)


def condition_of(name: Column) -> Column:
    found = F.regexp_extract(name, POSE, 0)
    return F.when(found == "", "unknown").otherwise(F.concat(F.regexp_extract(name, POSE, 1), F.lit("m_"), F.regexp_extract(name, POSE, 2), F.lit("deg")))


def recording_of(frame: Column) -> Column:
    return F.split(frame, "_frame_")[0]


def location_of(frame: Column) -> Column:
    """Name tokens that are no light, altitude, angle or number."""
    parts = F.split(F.replace(recording_of(frame), F.lit(" "), F.lit("")), "_")
    keep = F.filter(parts, lambda t: (t != "") & ~t.isin("day", "night") & ~t.rlike(r"^(\d+m|\d+c|\d+)$"))
    return F.array_join(keep, "_")


def first_token(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")[0]
