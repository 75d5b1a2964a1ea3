"""Order-dependent operators over trial logs.

Row order is meaningful in the reference (cumcount, shift, diff, bfill,
keep-first). Here every operator takes an explicit ``order_by`` list that must
be a total order (R17); nothing depends on physical row order.

Partitioning: all windows of one log share the same partition keys, so Spark
sorts once per key set; when data is already hash-partitioned on a subset of
the keys (e.g. on ``list`` after a join), no further exchange is planned.

Windows keyed by a list are bounded by the experiment's design. Where a group has no bound
(all events of a user), ``diff`` and ``backward_fill`` take a ``bucket``, an expression that does not
fall along the order (a time range): rows are scanned inside (keys, bucket), each bucket hands on one
carry (its last value, or its first known one), a window over the carries - one row a bucket - finds
what enters each bucket, and only that is joined back. Duplicates over such groups are an aggregate
joined back (``duplicate_flags``).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.session import stage_table


def _w(keys: Sequence[str], order_by: Sequence[str | Column] | None = None):
    w = Window.partitionBy(*keys)
    return w.orderBy(*order_by) if order_by else w


def _keys_present(keys: Sequence[str]) -> Column:
    """Pandas group-by drops rows whose key is missing; they get NULL results."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def occurrence_number(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], item: str,
                      name: str = "rep_num") -> DataFrame:
    """1-based occurrence of an item within its group; NULL when the item is missing."""
    return df.withColumn(name, F.when(_keys_present([*keys, item]),
                                      F.row_number().over(_w([*keys, item], order_by)).cast("bigint")))


def running_position(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                     name: str = "outpos", zero_based: bool = False) -> DataFrame:
    """W2 (1-based output position) / W3 (0-based type occurrence)."""
    rn = F.row_number().over(_w(keys, order_by)) - (1 if zero_based else 0)
    return df.withColumn(name, F.when(_keys_present(keys), rn.cast("bigint")))


def group_max(df: DataFrame, keys: Sequence[str], col: str | Column, name: str) -> DataFrame:
    """Group maximum (booleans: any) broadcast to every row of the group."""
    c = F.col(col) if isinstance(col, str) else col
    return df.withColumn(name, F.max(c).over(_w(keys)))


def group_count(df: DataFrame, keys: Sequence[str], col: str | None, name: str) -> DataFrame:
    """Count of non-null ``col`` (or rows) broadcast to every row of the group."""
    c = F.count(col) if col else F.count(F.lit(1))
    return df.withColumn(name, c.over(_w(keys)))


def group_distinct_count(df: DataFrame, keys: Sequence[str], col: str, name: str) -> DataFrame:
    """Distinct count broadcast to rows. Spark has no DISTINCT window aggregate, so it is
    an aggregate joined back on the keys (partial aggregation keeps hot groups cheap)."""
    counts = df.groupBy(*keys).agg(F.countDistinct(col).alias(name)).select(
        *[F.col(k).alias(f"_d_{k}") for k in keys], name)
    return df.join(counts, [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys], "left").drop(
        *[f"_d_{k}" for k in keys])


def lag_columns(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], cols: Sequence[str],
                prefix: str = "prev_") -> DataFrame:
    """Previous row's values inside the group (one shared window)."""
    w = _w(keys, order_by)
    return df.withColumns({f"{prefix}{c}": F.when(_keys_present(keys), F.lag(c).over(w)) for c in cols})


def _carried(df: DataFrame, keys: Sequence[str], bucket: Column, carry: Column, entering) -> DataFrame:
    """``df`` with ``_bucket`` and ``_in``: what enters each (keys, bucket) group, by ``entering`` (the carry and the
    window over a group's buckets) from the carries of the group's other buckets."""
    x = df.withColumn("_bucket", bucket)
    per = x.groupBy(*keys, "_bucket").agg(carry.alias("_carry"))
    per = per.withColumn("_in", entering(F.col("_carry"), Window.partitionBy(*keys))).drop("_carry")
    own = per.select(*[F.col(c).alias(f"_c_{c}") for c in [*keys, "_bucket"]], "_in")
    return x.join(own, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in [*keys, "_bucket"]], "left").drop(
        *[f"_c_{c}" for c in [*keys, "_bucket"]])


def diff(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], col: str, name: str, bucket: Column | None = None) -> DataFrame:
    """Gap to the previous row of the group; NULL for the first row and for NULL keys. With ``bucket`` in two
    passes: the first row of a bucket takes the last value of the bucket before."""
    if bucket is None:
        w = _w(keys, order_by)
        return df.withColumn(name, F.when(_keys_present(keys), F.col(col) - F.lag(col).over(w)))
    x = _carried(df, keys, bucket, F.max_by(col, F.struct(*order_by)), lambda c, w: F.lag(c).over(w.orderBy("_bucket")))
    w = _w([*keys, "_bucket"], order_by)
    before = F.when(F.row_number().over(w) == 1, F.col("_in")).otherwise(F.lag(col).over(w))
    return x.withColumn(name, F.when(_keys_present(keys), F.col(col) - before)).drop("_bucket", "_in")


def backward_fill(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], col: str,
                  name: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Replace NULL by the next non-null value of the group.

    Written as a forward fill over the reversed order (``last(ignorenulls)`` over a
    growing frame) - a streaming O(n) frame, where ``first`` over
    ``current row .. unbounded following`` re-evaluates the whole tail per row. With ``bucket`` in
    two passes: a bucket's open end takes the first known value of the buckets behind it.
    """
    rev = [F.col(c).desc_nulls_last() if isinstance(c, str) else c for c in order_by]

    def fill(c, w):
        return F.last(c, ignorenulls=True).over(w)
    if bucket is None:
        filled = fill(col, _w(keys, rev).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(name or col, F.when(_keys_present(keys), filled).otherwise(F.col(col)))
    # rows that have a value pass as they are; only the open rows meet a narrow table (keys, order, value) of the known
    out, by = name or col, [*keys, "_bucket"]
    is_open = F.col(col).isNull() & _keys_present(keys)
    rest = df.where(~is_open).withColumn(out, F.col(col))
    named = list(dict.fromkeys([*keys, *order_by, col]))
    known = df.where(F.col(col).isNotNull() & _keys_present(keys)).withColumn("_bucket", bucket).select(*named, "_bucket", F.lit(False).alias("_open"))
    open_rows = df.where(is_open).withColumn("_bucket", bucket).withColumn("_open", F.lit(True))
    x = open_rows.unionByName(known, allowMissingColumns=True)
    x = x.withColumn("_own", fill(col, _w(by, rev).rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_open").drop("_open")
    # what enters a bucket: the first known value of the buckets behind it
    per = known.groupBy(*by).agg(F.min_by(col, F.struct(*order_by)).alias("_carry")).unionByName(
        open_rows.select(*by).distinct(), allowMissingColumns=True).groupBy(*by).agg(
        F.max("_carry").alias("_carry"), F.max(F.col("_carry").isNull()).alias("_asked"))
    behind = Window.partitionBy(*keys).orderBy(F.col("_bucket").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_in", fill("_carry", behind)).where("_asked").select(*[F.col(c).alias(f"_c_{c}") for c in by], "_in")
    x = x.join(per, [F.col(c).eqNullSafe(F.col(f"_c_{c}")) for c in by], "left")
    filled = x.withColumn(out, F.coalesce("_own", "_in")).drop("_own", "_in", "_bucket", *[f"_c_{c}" for c in by])
    return rest.unionByName(filled)


def duplicate_flags(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], every: str, later: str) -> DataFrame:
    """W10 + W11 over groups without a bound: ``every`` marks all rows of a key combination that occurs more than
    once, ``later`` all but the first of them. One partial aggregation per key and a null-safe join back."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order_by)).alias("_first"))
    per = per.where("_n > 1").select(*[F.col(k).alias(f"_d_{k}") for k in keys], "_first")
    x = df.join(per, [F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in keys], "left")
    many = F.col("_first").isNotNull()
    return x.withColumns({every: many, later: many & ~F.struct(*order_by).eqNullSafe(F.col("_first"))}).drop(
        "_first", *[f"_d_{k}" for k in keys])


def mark_all_duplicates(df: DataFrame, keys: Sequence[str], name: str = "is_duplicate") -> DataFrame:
    """True on every row whose key combination occurs more than once (NULLs equal, R7)."""
    return df.withColumn(name, F.count(F.lit(1)).over(_w(keys)) > 1)


def mark_later_duplicates(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                          name: str = "is_duplicate") -> DataFrame:
    """True on every occurrence after the first (keep='first')."""
    return df.withColumn(name, F.row_number().over(_w(keys, order_by)) > 1)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """A18 subset form: one row per key, the first in the given order (deterministic)."""
    rn = F.row_number().over(_w(keys, order_by))
    return df.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def recall_positions(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], recalled: str = "recalled",
                     item: str = "item") -> DataFrame:
    """W2 + W11 + J4 for logs whose recall events are flagged rows of the same table.

    ``outpos_rec``: running count of recalled rows in output order (set on recalled rows);
    ``outpos``: the output position of the first recall of the row's item in its list (the
    value the reference attaches to presented items by joining the first, non-repeated
    recall). Both are windows over the list, so no self-join and no extra shuffle.
    """
    is_rec = F.col(recalled) == 1
    running = F.sum(is_rec.cast("bigint")).over(
        _w(keys, order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.withColumn("outpos_rec", F.when(is_rec, running))
    first = F.min("outpos_rec").over(_w([*keys, item]))
    return out.withColumn("outpos", F.when(F.col(item).isNotNull(), first))


def row_order(df: DataFrame, order_by: Sequence[str], name: str = "row_order") -> DataFrame:
    """A total-order id from 0, the same however the rows are partitioned.

    Rows are range-partitioned and sorted, and numbered inside their partition; the partitions' row counts, summed
    up, are their offsets. The sorted rows are a written table in the shared checkpoint folder, so the number inside
    a partition does not change when an executor is lost.
    """
    by = list(order_by)
    at = "_at"
    dealt = stage_table(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()),
                        f"row-order-{uuid.uuid4().hex}")
    part = F.shiftright(at, 33).alias("_part")
    counts = dealt.groupBy(part).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # one row per partition of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .select(*df.columns, (F.col(at) + F.col("_shift")).alias(name)))
