"""Column helpers that give the reference's missing-value semantics in Spark.

Each helper corresponds to one parity rule: NaN is canonicalised to NULL at the
source (R1), `x == x` means "is not null" (R2), comparisons with a missing side
are False rather than NULL (R3), `!=` against NULL is True (R4), whitespace trim
covers all Unicode space (R8), a zero denominator gives NULL (R9), Fisher z is
clamped (R12) and regex misses become NULL before an integer cast (R14).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN -> NULL, so that NaN never passes a comparison or forms a group."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clean_nan(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """R1 for every float/double column (or the given ones)."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    cols = list(cols)
    return df.withColumns({c: nan_to_null(c) for c in cols}) if cols else df


def eq_false(a: str | Column, b) -> Column:
    """Equality that is False (not NULL) when either side is missing."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.coalesce(col_(a) == b, F.lit(False))


def cond_false(cond: Column) -> Column:
    """R3 for any predicate: NULL -> False."""
    return F.coalesce(cond, F.lit(False))


def ne_true(a: str | Column, b) -> Column:
    """Inequality that is True when the column is NULL."""
    b = b if isinstance(b, Column) else F.lit(b)
    return ~col_(a).eqNullSafe(b)


def present(c: str | Column) -> Column:
    """R2: the reference's `x == x` test."""
    return col_(c).isNotNull()


# The characters Python's str.strip() removes, derived from str.isspace (not listed by hand)
WHITESPACE = "".join(ch for ch in map(chr, range(0x110000)) if ch.isspace())


def strip_ws(c: str | Column) -> Column:
    """Strip leading/trailing whitespace of any kind, as Python's str.strip() does
    (Spark's trim removes spaces only); a character-set trim, no regular expression."""
    return F.btrim(col_(c), F.lit(WHITESPACE))


def strip_lower(c: str | Column) -> Column:
    return F.lower(strip_ws(c))


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Division that yields NULL for a zero or NULL denominator."""
    return F.try_divide(col_(a), col_(b))


def fisher_z(r: str | Column) -> Column:
    """Arctanh of a correlation, clamped into [-1, 1] (|r|=1 -> +-inf, as arctanh does).

    NULL stays NULL: ``least`` and ``greatest`` skip NULLs, so the clamp alone would turn an
    undefined correlation into 1."""
    r = col_(r)
    return F.when(r.isNotNull(), F.atanh(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))))


def trailing_int(c: str | Column) -> Column:
    """Trailing digits of a label as an integer, NULL when there are none."""
    return F.nullif(F.regexp_extract(col_(c), r"(\d+)$", 1), F.lit("")).try_cast("int")


def sentinel_to_null(c: str | Column, sentinels: Iterable) -> Column:
    """Replace sentinel values (-999, 'NA', ...) with NULL."""
    c = col_(c)
    vals = list(sentinels)
    return F.when(c.isin(vals), F.lit(None)).otherwise(c)


def null_to_sentinel(df: DataFrame, mapping: dict) -> DataFrame:
    """Inverse of sentinel_to_null, for export formats that cannot hold NULL."""
    return df.fillna(mapping)


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round the binary value half away from zero at ``digits`` decimals and turn -0.0 into 0.0.

    ``F.round`` rounds the shortest decimal string HALF_UP, so an exact decimal tie
    (common for money amounts) rounds up even when the stored double lies just below
    it; rounding ``x * 10**digits`` as a double gives the conventional result.
    """
    x = col_(c).cast("double")
    m = float(10 ** digits)
    scaled = F.floor(F.abs(x) * m + F.lit(0.5)).cast("double") * F.signum(x) / F.lit(m)
    # from 2^53 / 10^digits on, neighbouring doubles lie further apart than the rounding step:
    # rounding is the identity there
    safe = F.when(F.isnan(x) | (F.abs(x) >= F.lit(float(2 ** 53) / m)), x).otherwise(scaled)
    return safe + F.lit(0.0)
