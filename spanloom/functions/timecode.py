"""Times as text, file names, kinds of sound files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hours_timestamp(ms: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = ms.cast("long")
    whole = lambda by: F.floor(ms / by)
    return F.format_string("%02d:%02d:%02d.%03d", whole(3_600_000), whole(60_000) % 60, whole(1000) % 60, ms % 1000)


def minutes_timestamp(ms: Column) -> Column:
    """MM:SS.mmm, with as many minutes as it takes."""
    ms = ms.cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60_000), F.floor(ms / 1000) % 60, ms % 1000)


def parse_time(text: Column) -> Column:
    """MM:SS.mmm or seconds, as whole ms cut off; 0 for what can't be read."""
    parts = F.split(text, ":")
    timed = (F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("double")) * 1000
    plain = text.try_cast("double") * 1000
    return F.coalesce(F.when(F.contains(text, F.lit(":")), timed).otherwise(plain).try_cast("long"), F.lit(0).cast("long"))


def file_name(name: Column) -> Column:
    """Without the characters that file systems forbid; blanks stay."""
    clean = F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*]', "_")
    return F.when(clean == "", "dictation_final").otherwise(clean)


def sound_type(content: Column) -> Column:
    head = F.substring(content, 1, 4)
    return F.when(head == F.lit(b"RIFF"), "audio/wav").when(head == F.lit(b"fLaC"), "audio/flac").otherwise("audio/mpeg")
