"""Cleaning, filters and column reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.text import alphabetic, contains_ci, number_flag, strip_bytes_wrapper


def standardize(df: DataFrame, symbol: Column, oncogene: Column, tsg: Column) -> DataFrame:
    """Any source as the common list shape ``(symbol, oncogene, tsg)``."""
    return df.select(symbol.alias("symbol"), oncogene.alias("oncogene"), tsg.alias("tsg"))


def filter_any_flag(df: DataFrame, a: str = "oncogene", b: str = "tsg") -> DataFrame:
    """Rows with any flag set."""
    return df.filter(F.col(a) | F.col(b))


def filter_no_flag(df: DataFrame, a: str = "oncogene", b: str = "tsg") -> DataFrame:
    """Rows with both flags clear; a null flag is neither set nor clear."""
    return df.filter(~F.col(a) & ~F.col(b))


def numeric_flag_to_bool(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``== 1`` flags as booleans, null as false."""
    return df.withColumns({c: number_flag(c) for c in columns})


def role_flags_from_text(df: DataFrame, tier_column: str, tier: int, role_column: str) -> DataFrame:
    """Rows of one tier with the flags found in the free-text role."""
    return df.filter(F.col(tier_column) == tier).withColumns(
        {"oncogene": contains_ci(role_column, "oncogene"), "tsg": contains_ci(role_column, "tsg")}
    )


def combined_flag_key(df: DataFrame, a: str, b: str, neutral: str = "NoNo", keep: bool = False) -> DataFrame:
    """Filter on two concatenated text flags: drop (or keep) rows where both are neutral."""
    df = df.withColumn("flag_key", F.concat(a, b))
    return df.filter(F.col("flag_key") == neutral if keep else F.col("flag_key") != neutral)


def numeric_flag_sum(df: DataFrame, key: str, a: str, b: str, order: Sequence[str]) -> DataFrame:
    """Sum of two numeric flags; rows with a null flag are dropped, the first row per key is kept."""
    from labelweave.operators.dedupe import dedupe_first

    summed = df.withColumn("flag_sum", F.col(a) + F.col(b)).filter("flag_sum IS NOT NULL")
    return dedupe_first(summed, [key], order)


def filter_by_type(df: DataFrame, column: str, value: str, equal: bool = True) -> DataFrame:
    """Rows (not) of one category."""
    return df.filter(F.col(column) == value if equal else F.col(column) != value)


def filter_keyword_ci(df: DataFrame, column: str, keyword: str) -> DataFrame:
    """Rows whose text contains the keyword in any case."""
    return df.filter(contains_ci(column, keyword))


def split_explode_members(df: DataFrame, column: str, name: str = "symbol") -> DataFrame:
    """Distinct trimmed members of a comma- or space-separated list column."""
    members = df.select(F.explode(F.split(F.col(column), r"[,\s]+")).alias(name))
    return members.filter(F.col(name) != "").distinct()


def valid_symbol_filter(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Approved form of known symbols; unknown ones stay only when purely alphabetic."""
    trimmed = df.withColumn(column, F.trim(column))
    known = dictionary.select(
        F.col("input").alias(column), F.col("approved").alias("_approved"), F.lit(True).alias("_known")
    )
    joined = trimmed.join(known, column, "left")
    return (
        joined.filter(F.col("_known") | alphabetic(column))
        .withColumn(column, F.when(F.col("_known"), F.col("_approved")).otherwise(F.col(column)))
        .drop("_approved", "_known")
    )


def drop_null_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.dropna(subset=list(keys))


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def fill_missing(df: DataFrame, array_column: str | None = None, value: float = 0.0) -> DataFrame:
    """Replace missing features, in plain columns or inside a feature array."""
    if array_column is None:
        return df.fillna(value)
    filled = F.transform(array_column, lambda x: F.coalesce(x, F.lit(value)))
    return df.withColumn(array_column, filled)


def drop_self_loops(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return edges.filter(F.col(src) != F.col(dst))


def drop_invalid_nodes(edges: DataFrame, src: str = "src", dst: str = "dst", placeholder: str = "-") -> DataFrame:
    """Strip ``$`` from the names and drop edges touching the placeholder node."""
    clean = {c: F.replace(F.col(c), F.lit("$"), F.lit("")) for c in (src, dst)}
    return edges.withColumns(clean).filter((F.col(src) != placeholder) & (F.col(dst) != placeholder))


def exclude_rows_by_key(df: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Remove the rows named in an exclusion table."""
    return df.join(excluded.select(*keys), list(keys), "left_anti")


def clean_column_names(df: DataFrame, value_columns: Sequence[str] = ()) -> DataFrame:
    """Unwrap ``b'...'`` in column names and in the given text columns; columns sorted by name."""
    names = [c[2:-1] if c.startswith("b'") and c.endswith("'") else c for c in df.columns]
    renamed = df.toDF(*names)
    unwrapped = renamed.withColumns({c: strip_bytes_wrapper(c) for c in value_columns})
    return unwrapped.select(*sorted(names))


#: Named feature groups as (first position, length) in the feature array.
FEATURE_GROUPS: dict[str, tuple[int, int]] = {
    "CNA": (0, 16),
    "Gene_Expression": (16, 16),
    "DNA_Methylation": (32, 16),
    "Mutations": (48, 16),
    "Multiomics": (0, 64),
}


def select_feature_group(
    df: DataFrame,
    features: str,
    group: str,
    groups: Mapping[str, tuple[int, int]] = FEATURE_GROUPS,
) -> DataFrame:
    """Keep the slice of the feature array that belongs to a named group."""
    if group not in groups:
        raise ValueError(f"unknown feature group {group!r}; known are {sorted(groups)}")
    start, length = groups[group]
    return df.withColumn(features, F.slice(features, start + 1, length))


def recode_label(df: DataFrame, column: str) -> DataFrame:
    """True / False, as booleans or text, to 1 / 0; anything else to null."""
    text = F.lower(F.col(column).cast("string"))
    return df.withColumn(column, F.when(text == "true", 1).when(text == "false", 0))


def columns_subset_drop(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def find_key(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with an exact key."""
    return df.filter(F.col(column) == F.lit(value))


def any_match(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """One row per column: does any value contain ``text``?"""
    hits = df.agg(
        *[F.coalesce(F.bool_or(F.col(c).contains(text)), F.lit(False)).alias(c) for c in columns]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("found")) for c in columns])
    return hits.select(F.inline(pairs))


def value_counts(df: DataFrame, columns: Sequence[str], with_nulls: bool = True) -> DataFrame:
    """Rows per value."""
    if not with_nulls:
        df = df.dropna(subset=list(columns))
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """Null count per column plus the total, in one pass: ``(column, nulls)``."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    total = reduce(lambda a, b: a + b, [F.col(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in df.columns]
    pairs.append(F.struct(F.lit("(total)").alias("column"), total.alias("nulls")))
    return counts.select(F.inline(F.array(*pairs)))


def feature_range(df: DataFrame, features: str) -> DataFrame:
    """Global minimum and maximum of a feature array, rows and widths."""
    return df.agg(
        F.min(F.array_min(features)).alias("min_value"),
        F.max(F.array_max(features)).alias("max_value"),
        F.count("*").alias("n_rows"),
        F.min(F.size(features)).alias("min_width"),
        F.max(F.size(features)).alias("max_width"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct values per column."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
    # one small shuffle per column instead of a single wide expand over all of them
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")).distinct() for c in columns]
    united = reduce(DataFrame.unionByName, parts)
    return united.filter("v IS NOT NULL").groupBy("column").agg(F.count("*").alias("n_distinct"))


def sort_by_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys)


def head_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of an order (each task keeps ``n`` rows)."""
    return df.orderBy(*order).limit(n)


def union_distinct_keys(frames: Sequence[DataFrame], column: str) -> DataFrame:
    """Set union of keys; every source is reduced to its keys before the shared shuffle."""
    return reduce(DataFrame.unionByName, [f.select(column) for f in frames]).distinct()


def intersect_keys(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).intersect(right.select(column))


def except_keys(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    return left.select(column).distinct().join(right.select(column), column, "left_anti")
