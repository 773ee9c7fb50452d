"""Names and codes as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import join_on

# Name suffixes that are not last names.
NAME_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")


def short_name(name: Column) -> Column:
    """``First Last`` to ``F.Last``; names with a period or one word pass through."""
    clean = F.trim(name)
    parts = F.split(clean, r"\s+")
    short = F.concat(F.substring(clean, 1, 1), F.lit("."), F.element_at(parts, -1))
    return F.when(clean.contains(".") | (F.size(parts) < 2), clean).otherwise(short)


def last_name(name: Column) -> Column:
    """Lower-case last name without suffix; letters, hyphen and apostrophe only."""
    words = F.filter(F.split(F.lower(F.regexp_replace(name, r"[^A-Za-z\-']", " ")), " "), lambda w: w != "")
    final = F.element_at(words, -1)
    suffixed = final.isin(*NAME_SUFFIXES) & (F.size(words) >= 2)
    return F.when(F.size(words) < 1, F.lit("")).when(suffixed, F.try_element_at(words, F.lit(-2))).otherwise(F.try_element_at(words, F.lit(-1)))


def name_key(name: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def alias_candidates(raw: Column) -> Column:
    """Alternative names split on ``/`` or ``,`` without bracketed parts and apostrophes."""
    parts = F.transform(F.split(raw, "[/,]"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"\(.*?\)", ""), "'", "")))
    return F.filter(parts, lambda p: p != "")


def match_aliases(df: DataFrame, row_id: str, raw: str, lookup: DataFrame, name: str, ident: str) -> DataFrame:
    """First alias of each row that the lookup knows, with its id; unmatched rows keep their text."""
    known = lookup.select(name_key(F.col(name)).alias("_key"), F.col(ident)).groupBy("_key").agg(F.min(ident).alias(ident))
    tried = df.select(row_id, F.posexplode(alias_candidates(F.coalesce(F.col(raw), F.lit("")))).alias("_pos", "_alias"))
    tried = tried.withColumn("_key", name_key(F.col("_alias"))).join(known, "_key", "inner")
    best = tried.groupBy(row_id).agg(F.min_by(F.struct("_alias", ident), "_pos").alias("_best"))
    out = join_on(df, best, row_id)
    return out.withColumns(
        {"matched_name": F.coalesce(F.col("_best._alias"), F.trim(raw)), ident: F.col(f"_best.{ident}")}
    ).drop("_best")


def clean_text(value: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def clean_status(value: Column) -> Column:
    """Upper-case trimmed status; blank becomes NULL."""
    text = F.upper(clean_text(value))
    return F.when(F.length(text) > 0, text)


def normalize_code(value: Column, table: Mapping[str, str]) -> Column:
    """Upper-case code mapped through a small table; unknown codes pass through as they are."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), F.upper(F.trim(value))) if pairs else F.lit(None).cast("string")
    return F.coalesce(found, F.trim(value))


def map_ids(df: DataFrame, mapping: DataFrame, source: str, target: str, names: Sequence[str] = ()) -> DataFrame:
    """Map ids through a cross-reference; where that fails, by a name key inside ``names`` columns."""
    direct = mapping.where(F.col(source).isNotNull()).groupBy(source).agg(F.min(target).alias(target))
    out = join_on(df, direct, source)
    if names:
        by_name = mapping.groupBy(*names).agg(F.min(target).alias("_by_name"))
        out = join_on(out, by_name, list(names)).withColumn(target, F.coalesce(target, "_by_name")).drop("_by_name")
    return out
