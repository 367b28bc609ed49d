"""What the encoders share inside one document, as queries over many: layouts, repeated values, prefixes of strings, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import sorted_rank


def layout_of(j: Column) -> Column:
    """The keys of a JSON object in their order, which counts."""
    return F.json_object_keys(j)


def layout_catalogue(df: DataFrame, json_col: str) -> DataFrame:
    """layout (keys joined by commas), keys, n_docs, layout_id (0, 1, ... in byte order of layout, then keys): one row per layout.

    Layouts are told apart by their keys, not by the joined text. Counting combines on the map side; the numbering sees layouts only, range-partitioned.
    """
    per = df.select(layout_of(F.col(json_col)).alias("keys")).where("keys is not null").groupBy("keys").agg(F.count(F.lit(1)).alias("n_docs"))
    return sorted_rank(per.select(F.array_join("keys", ",").alias("layout"), "keys", "n_docs"), "layout", "keys", rank="layout_id")


def value_catalogue(df: DataFrame, value_cols: list[str], order_col: str) -> DataFrame:
    """One row per different value: the values, first (smallest order_col) and uses. What a dictionary would hold; map-side combining, no window over hot values."""
    return df.groupBy(*value_cols).agg(F.min(order_col).alias("first"), F.count(F.lit(1)).alias("uses"))


def with_first_use(df: DataFrame, value_cols: list[str], order_col: str, first: str = "first", is_first: str = "is_first") -> DataFrame:
    """df with the first use of each row's value: rows other than the first are what a pointer would replace. The join's row side is splittable, so a hot value isn't one task."""
    cat = value_catalogue(df, value_cols, order_col).drop("uses").withColumnRenamed("first", "_first")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in value_cols]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = df.alias("l").join(cat.alias("r"), cond).select("l.*", F.col("r._first").alias(first))
    return out.withColumn(is_first, F.col(order_col) == F.col(first))


def is_cheap(v: Column) -> Column:
    """Values that sharing never pays for: null, booleans, integers within 2048 of zero, texts of one character at most. v: VARIANT."""
    kind = F.schema_of_variant(v)
    small = F.abs(F.try_variant_get(v, "$", "double")) <= 2048
    whole = F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))
    number = ~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT")
    return F.when(kind.isin("VOID", "BOOLEAN"), True).when(kind == "STRING", F.length(F.try_variant_get(v, "$", "string")) <= 1).when(number, small & whole).otherwise(False)


def chain_prefix(s: Column, delimiters: str = "/.") -> Column:
    """The text before its last delimiter ('' without one, or with one in front only)."""
    own = "".join("\\" + c for c in delimiters)
    return F.regexp_extract(s, f"^(.+)[{own}][^{own}]*$", 1)


def prefix_catalogue(df: DataFrame, text_col: str, delimiters: str = "/.", least: int = 2) -> DataFrame:
    """prefix, uses: prefixes at delimiters that at least `least` rows share."""
    own = "".join("\\" + c for c in delimiters)
    t = F.col(text_col)
    cuts = F.filter(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length(t))), lambda i: F.substring(t, i, F.lit(1)).rlike(f"[{own}]"))
    each = df.where(t.isNotNull()).select(F.explode(F.transform(cuts, lambda i: F.substring(t, F.lit(1), i - 1))).alias("prefix"))
    return each.groupBy("prefix").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= least)


def needs_index(n_children: Column, over: int = 16) -> Column:
    return n_children > over
