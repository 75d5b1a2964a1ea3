"""Bipolar electrode-pair screen (Q14: P14-P18, J7, W6, O4).

Contacts and pairs are small per montage but many montages exist; both are
plain tables keyed by (subject, montage). The two contact lookups are equi-joins
(Spark broadcasts the contacts when their measured size allows it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.functions.nulls import ne_true, trailing_int

COORDS = ["vox_x", "vox_y", "vox_z"]


def screen_pairs(pairs: DataFrame, contacts: DataFrame, keys: list[str], micro_type: str = "uD",
                 depth_type: str = "D", max_dist: float = 25.0, min_pairs: int = 10,
                 count_keys: list[str] | None = None) -> DataFrame:
    """Q14 end to end.

    pairs: keys, contact_1, contact_2, and label ('A1-A2'), type_1, type_2 - or none of the three, which then come
    from the contacts (labels joined by a dash)
    contacts: keys, contact, label, vox_x, vox_y, vox_z (and type)
    """
    count_keys = count_keys or keys
    own = "type_1" in pairs.columns
    # Coordinates required
    c = contacts.dropna(subset=COORDS).select(*keys, "contact", "label", *([] if own else ["type"]), *COORDS)

    def side(k: int) -> DataFrame:
        return c.select(*keys, *[F.col(x).alias(f"{x}_{k}") for x in c.columns if x not in keys])
    # One lookup for each side, inner (pairs without contacts are dropped)
    j = pairs.join(side(1), [*keys, "contact_1"], "inner").join(side(2), [*keys, "contact_2"], "inner")
    if not own:
        j = j.withColumn("label", F.concat_ws("-", "label_1", "label_2"))
    dist = F.sqrt(sum((F.col(f"{x}_1") - F.col(f"{x}_2")) ** 2 for x in COORDS))
    parts = F.split("label", "-")
    j = j.withColumns({"dist": dist, "label_len": F.size(parts)})
    # No micro contacts, type present, both types equal
    typed = ne_true("type_1", micro_type) & F.col("type_1").isNotNull() & (F.col("type_1") == F.col("type_2"))
    # Neighbouring contact numbers for depth electrodes (R14: no digits -> NULL -> dropped)
    num_dist = F.abs(trailing_int(F.get(parts, F.lit(0))) - trailing_int(F.get(parts, F.lit(1))))
    # >2 parts kept as they are; =2 checked against the contact labels, P17 and P18 (strict distance bound); =1 dropped
    two = ((F.col("label_len") == 2) & (F.col("label_1") == F.get(parts, F.lit(0))) & (F.col("label_2") == F.get(parts, F.lit(1)))
           & ((num_dist == 1) | ne_true("type_1", depth_type)) & (F.col("dist") < max_dist))
    final = j.where(typed & ((F.col("label_len") > 2) | two))
    # Pairs per montage, keep montages with at least min_pairs (aggregate joined back:
    # partially aggregated, so a montage with very many pairs is never gathered in one task)
    counts = final.groupBy(*count_keys).agg(F.count("label").alias("n_contacts")).select(
        *[F.col(k).alias(f"_c_{k}") for k in count_keys], "n_contacts")
    final = final.join(counts, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in count_keys], "left").drop(
        *[f"_c_{k}" for k in count_keys])
    return final.where(F.col("n_contacts") >= min_pairs)
