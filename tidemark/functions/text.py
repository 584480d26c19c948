"""String, parsing and time expressions of frame names, paths and worksheet cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
MISSING_INDEX = -1


def frame_prefix(stem: Column) -> Column:
    """Everything before the trailing digits; the whole stem without any."""
    return F.regexp_replace(stem, r"[0-9]+$", "")


def frame_index(stem: Column) -> Column:
    """The trailing digits as a number, -1 without any."""
    return F.coalesce(F.regexp_extract(stem, r"([0-9]+)$", 1).try_cast("bigint"), F.lit(MISSING_INDEX).cast("bigint"))


def clean_prefix(prefix: Column) -> Column:
    """Without a `_CV` ending and trailing separators; `video` when nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(prefix, r"_CV$", ""), r"[_-]+$", "")
    return F.when(bare == "", F.lit("video")).otherwise(bare)


def block_id(prefix: Column, number: Column, size: int) -> Column:
    """Frames in numbered blocks of a fixed size."""
    return F.concat_ws("_", prefix, F.format_string("%04d", F.floor(number / size)))


def category(name: Column) -> Column:
    """Up to `_CV`, else up to the first underscore, else the name."""
    return F.when(name.contains("_CV"), F.substring_index(name, "_CV", 1)).otherwise(F.substring_index(name, "_", 1))


def posix(path: Column) -> Column:
    """Forward slashes."""
    return F.regexp_replace(path, r"\\", "/")


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(posix(path), "/"), -1), r"(?<=.)\.[^.]*$", "")


def clip_id(path: Column) -> Column:
    """Stem and ten digits of the path's SHA-256."""
    return F.concat_ws("-", stem(path), F.substring(F.sha2(path, 256), 1, 10))


def clock_time(seconds: Column) -> Column:
    """HH:MM:SS.mmm with milliseconds rounded half to even."""
    ms = F.bround(seconds * 1000).cast("bigint")

    def part(value: Column, width: int) -> Column:
        return F.lpad(value.cast("string"), width, "0")

    hours = F.floor(ms / 3600000).cast("string")
    return F.concat(
        F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"),
        part(F.floor(ms / 60000) % 60, 2), F.lit(":"), part(F.floor(ms / 1000) % 60, 2), F.lit("."), part(ms % 1000, 3),
    )


def number(cell: Column) -> Column:
    """A finite number written plainly, else null; casts alone would take '5d' or 'NaN'."""
    bare = F.trim(cell)
    value = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def integer(cell: Column) -> Column:
    bare = F.trim(cell)
    return F.when(bare.rlike(INTEGER), bare.try_cast("bigint"))


def accepted_number(name: str, cell: Column) -> Column:
    """struct<value, ok>; blank is an accepted null, flags are 0 or 1, times are -1 or at least 0."""
    value = number(cell)
    blank = F.coalesce(F.trim(cell) == "", F.lit(True))
    if name.startswith("should_"):
        fine = value.isin(0.0, 1.0)
    elif name.startswith("t_"):
        fine = (value >= 0) | (value == -1)
    else:
        fine = value.isNotNull()
    return F.struct(F.when(~blank, value).alias("value"), (blank | F.coalesce(fine, F.lit(False))).alias("ok"))


def safe_float(cell: Column, default: float = 0.0, digits: int | None = None) -> Column:
    """Null, NaN and infinities become the default."""
    value = cell.try_cast("double")
    fine = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    value = F.coalesce(fine, F.lit(float(default)))
    return F.round(value, digits) if digits is not None else value


def aspect_text(width: Column, height: Column) -> Column:
    """Width / height with three decimals."""
    return F.when(height > 0, F.format_string("%.3f", width / height)).otherwise("0.000")


def guarded_cell(cell: Column) -> Column:
    """Cells that a spreadsheet would take for a formula get a leading apostrophe."""
    return F.when(cell.rlike(r"^[=+@\-\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def merged_counts(a: Column, b: Column) -> Column:
    """Sum of two counter maps."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def json_value(text: Column, path: str, kind: str) -> Column:
    """A nested value, null where it is absent or of another kind."""
    return F.get_json_object(text, path).try_cast(kind)


def embedded_json(html: Column, element: str) -> Column:
    """The text of a script element of a page."""
    return F.nullif(F.regexp_extract(html, rf"(?s)<script[^>]*id=\"{element}\"[^>]*>(.*?)</script>", 1), F.lit(""))
