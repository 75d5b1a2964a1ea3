"""Sample descriptions and coverage tables (ST15, ST16, A9, A20, A21, P22-P24, J10, J11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialspark.functions.nulls import strip_lower

# Placeholder strings treated as missing localizations, and the
# region names left out of the coverage count.
PLACEHOLDERS = ["nan", "unknown", "none", "[]", "left tc", "", " "]
EXCLUDED_REGIONS = ["Other", "Other Cortex", "Subcortical", "Occipital"]
REGION_SHORT_NAMES = {"Cingulate": "CC", "Other Temporal": "TL", "Parietal": "PL"}


def histogram(df: DataFrame, col: str, width: float, measure: str) -> DataFrame:
    """Counts per bin of ``width`` (bin labelled by its left edge)."""
    b = (F.floor(F.col(col) / width) * width).cast("bigint")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(measure).alias("measure"), "bin", "n")


def sample_summary(units: DataFrame, subject: str, session: str, lst: str, pairs_per: DataFrame | None = None,
                   pair_width: int = 20) -> DataFrame:
    """ST15: sessions per subject, lists per session (bin width 1) and the fewest pairs over
    a subject's montages (A9, bin width ``pair_width``)."""
    n_sess = units.groupBy(subject).agg(F.countDistinct(session).alias("x"))
    n_list = units.groupBy(subject, session).agg(F.countDistinct(lst).alias("x"))
    parts = [histogram(n_sess, "x", 1, "sessions_per_subject"),
             histogram(n_list, "x", 1, "lists_per_session")]
    if pairs_per is not None:
        parts.append(histogram(pairs_per, "x", pair_width, "min_pairs_per_subject"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def min_of_counts(df: DataFrame, subject: str, unit: str) -> DataFrame:
    """Rows per (subject, unit), then the minimum over the subject's units."""
    return df.groupBy(subject, unit).count().groupBy(subject).agg(F.min("count").alias("x"))


def clean_atlas(c: str | Column) -> Column:
    """Lower + strip whitespace, strip double quotes, placeholders -> NULL."""
    v = F.btrim(strip_lower(c), F.lit('"'))
    return F.when(v.isin(PLACEHOLDERS), F.lit(None)).otherwise(v)


def coalesce_priority(cols: Sequence[Column]) -> Column:
    """First non-null value in priority order."""
    return F.coalesce(*cols)


def region_coverage(loc: DataFrame, lookup: DataFrame, subject: str = "subject",
                    key: str = "subregion_original") -> tuple[DataFrame, DataFrame]:
    """ST16: subjects with at least one electrode per region (excluded regions dropped),
    short names (P22), plus a total row (A21); also returns unmatched localizations (J10).

    The lookup is de-duplicated on its key first (a repeated key would double counts).
    """
    # a key with two regions takes the smaller name, whatever the order of rows
    lk = lookup.groupBy(key).agg(F.min("region").alias("region"))
    j = loc.where(F.col(key).isNotNull()).join(lk, key, "left")
    unmatched = j.where(F.col("region").isNull())
    per = j.where(F.col("region").isNotNull()).groupBy(subject, "region").agg(
        F.count(F.lit(1)).alias("n_region_electrodes"))
    # one pass over the (subject, region) table: regions and the total as grouping sets; a subject has one row for
    # each region, so distinct subjects per region is a row count
    both = per.groupingSets([["region"], []], "region").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(subject).alias("n_all"), F.grouping("region").alias("whole"))
    out = both.where((F.col("whole") == 1) | ~F.col("region").isin(EXCLUDED_REGIONS)).select(
        F.when(F.col("whole") == 1, "Total Subjects").otherwise(F.col("region")).alias("region"),
        F.when(F.col("whole") == 1, F.col("n_all")).otherwise(F.col("n_rows")).alias("n_subjects"))
    return out.replace(REGION_SHORT_NAMES, subset=["region"]), unmatched


def attach_localization(pairs: DataFrame, loc: DataFrame, keys: Sequence[str] = ("subject", "montage", "label")
                        ) -> DataFrame:
    """Every pair with its localization row where one exists (left join on three keys)."""
    return pairs.join(loc, list(keys), "left")
