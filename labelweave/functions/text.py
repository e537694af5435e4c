"""Text helpers for keys, names and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def contains_ci(column: Column | str, keyword: str) -> Column:
    """Case-insensitive substring test; null text never matches."""
    return F.coalesce(F.lower(_col(column)).contains(keyword.lower()), F.lit(False))


def number_flag(column: Column | str) -> Column:
    """``== 1`` as a boolean; null counts as false."""
    return F.coalesce(_col(column) == F.lit(1.0), F.lit(False))


def yes_no(column: Column | str) -> Column:
    """Boolean to the 'Yes' / 'No' used in the exchanged files."""
    return F.when(_col(column), F.lit("Yes")).otherwise(F.lit("No"))


def is_yes(column: Column | str) -> Column:
    """'Yes' / 'No' to boolean; null counts as false."""
    return F.coalesce(_col(column) == F.lit("Yes"), F.lit(False))


def display_name(column: Column | str) -> Column:
    """``random_forest`` to ``Random Forest``."""
    return F.initcap(F.replace(_col(column), F.lit("_"), F.lit(" ")))


def slug(column: Column | str) -> Column:
    """``Random Forest`` to ``random_forest``."""
    return F.replace(F.lower(_col(column)), F.lit(" "), F.lit("_"))


def strip_bytes_wrapper(column: Column | str) -> Column:
    """Remove a ``b'...'`` wrapper left by a binary container."""
    return F.regexp_replace(_col(column), r"^b'(.*)'$", "$1")


def alphabetic(column: Column | str) -> Column:
    """True for non-empty text made of letters only."""
    return F.coalesce(_col(column).rlike(r"^\p{L}+$"), F.lit(False))


def strategy_name(column: Column | str) -> Column:
    """Balancing strategy from a run folder name: its last token, shortened where customary."""
    folder = _col(column)
    last = F.regexp_extract(folder, r"_([^_]+)$", 1)
    short = F.replace(last, F.lit("randomundersampler"), F.lit("rundersampler"))
    return F.when(last != "", short).otherwise(folder)


def run_folder_name(
    stamp: Column, source: Column, mode: Column, task: Column, strategy: Column, reduced: Column
) -> Column:
    """``YYYYMMDD_HHMMSS_source_mode_task[_strategy][_less]``."""
    return F.concat_ws(
        "_",
        F.date_format(stamp, "yyyyMMdd_HHmmss"),
        F.lower(source),
        F.lower(mode),
        F.lower(task),
        F.when(F.lower(strategy) != "none", F.lower(strategy)),
        F.when(reduced, F.lit("less")),
    )


def parse_run_folder(column: Column | str) -> Column:
    """Struct with the parts of a run folder name; a missing strategy reads as ``none``."""
    parts = F.split(_col(column), "_")
    size = F.size(parts)
    reduced = F.element_at(parts, -1) == "less"
    last = F.when(reduced, size - 1).otherwise(size)
    strategy = F.when(last > 5, F.array_join(F.slice(parts, F.lit(6), F.greatest(last - 5, F.lit(0))), "_"))
    stamp = F.concat_ws("_", F.element_at(parts, 1), F.try_element_at(parts, F.lit(2)))
    return F.struct(
        F.try_to_timestamp(stamp, F.lit("yyyyMMdd_HHmmss")).alias("started"),
        F.try_element_at(parts, F.lit(3)).alias("source"),
        F.try_element_at(parts, F.lit(4)).alias("mode"),
        F.try_element_at(parts, F.lit(5)).alias("task"),
        F.coalesce(strategy, F.lit("none")).alias("strategy"),
        reduced.alias("reduced"),
    )
