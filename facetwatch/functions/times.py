"""Time stamps and names in file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column | str) -> Column:
    """The last part of a path."""
    return F.element_at(F.split(path, "/"), -1)


def frame_time(path: Column | str, fallback: Column | None = None) -> Column:
    """Time of a frame from its file name.

    Read are ``20251005_075000`` anywhere in the name and
    ``image_2024-05-06_1000``; else ``fallback`` (a file's modification time).
    """
    name = base_name(path)
    parts = [
        F.try_to_timestamp(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss")),
        F.try_to_timestamp(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}_\d{4})", 1), F.lit("yyyy-MM-dd_HHmm")),
    ]
    return F.coalesce(*parts, *([fallback] if fallback is not None else []))


def camera_name(ts: Column | str, prefix: str = "IRCamM1T", suffix: str = "M.jpg") -> Column:
    """File name of a frame at a time."""
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(suffix))


def mirror_key(mirror_id: Column | str) -> Column:
    """``id_007`` for 7."""
    return F.format_string("id_%03d", mirror_id)


def mirror_of(key: Column | str) -> Column:
    """7 for ``id_007``."""
    return F.regexp_extract(key, r"^id_(\d+)$", 1).cast("int")


def int_list(text: Column | str) -> Column:
    """Integers of a comma list; blanks are skipped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def time_label(ts: Column | str) -> Column:
    """``05/10 07:50``."""
    return F.date_format(ts, "dd/MM HH:mm")
