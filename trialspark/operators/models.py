"""Model registry (ST3) and fitting of its fixed-effect part (ST4, ST5).

The registry maps experiment -> test period -> model name to the fixed-effect
part of the model formula; the response is the standardised similarity
(``scale(corr_z)``). Random-effect terms are not fitted (see README): the fixed
part is fitted by ordinary least squares from the model's cells (``cell_models``),
and effects at nested levels (ST6) stand in for random slopes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.operators import cell_models

# Fixed-effect parts of the registered model formulas, by experiment,
# test period and model name.
MODELS: dict[str, dict[str, dict[str, str]]] = {
    "catFR1": {
        "encoding": {
            "m1": "same_category * abs_serialpos_dist_center",
            "m1_final": "same_category * abs_serialpos_dist_scale",
        },
        "encoding_isi": {
            "m1": "(item_first + item_recalled) * item_before_isi_recalled * same_category"
                  " + recall_neighbor + recall_neighbor:same_category",
            "m1_final": "(item_first + item_recalled) * item_before_isi_recalled * same_category"
                        " + recall_neighbor + recall_neighbor:same_category",
        },
        "encoding_end": {
            "m1": "(item_first + item_recalled) * current_item_recalled * same_category"
                  " + recall_neighbor + recall_neighbor:same_category",
            "m1_final": "(item_first + item_recalled) * current_item_recalled * same_category"
                        " + recall_neighbor + recall_neighbor:same_category",
        },
        "distractor": {
            "m1": "(item_first + item_recalled) * serialpos_scale",
            "m1_final": "(item_first + item_recalled) * serialpos_scale",
        },
    },
    "FR1": {
        "encoding_isi": {
            "m1": "(item_first + item_recalled) * item_before_isi_recalled + recall_neighbor",
            "m1_final": "(item_first + item_recalled) * item_before_isi_recalled + recall_neighbor",
        },
        "encoding_end": {
            "m1": "(item_first + item_recalled) * current_item_recalled + recall_neighbor",
            "m1_final": "(item_first + item_recalled) * current_item_recalled + recall_neighbor",
        },
        "distractor": {
            "m1": "(item_first + item_recalled) * serialpos_scale",
            "m1_final": "(item_first + item_recalled) * serialpos_scale",
        },
    },
    "RepFR1": {
        "distractor": {
            "m1": "(item_first + item_recalled) * serialpos_scale",
            "m1_final": "(item_first + item_recalled) * serialpos_scale",
        },
    },
}


def model_formula(experiment: str, period: str, model: str | int) -> tuple[str, str]:
    """Lookup by name or by ordinal (0-based, in registry order). Returns (name, fixed part)."""
    cell = MODELS[experiment][period]
    if isinstance(model, int):
        name = list(cell)[model]
        return name, cell[name]
    return model, cell[model]


def registry_model(df: DataFrame, experiment: str, period: str, model: str | int, response: str = "corr_z",
                   keys: Sequence[str] = ()) -> cell_models.Model:
    """A registered model over the columns of ``df`` (a misnamed variable is an error, not a silently different model)."""
    return cell_models.model(df, response, model_formula(experiment, period, model)[1], keys)


def fit_registry_model(df: DataFrame, experiment: str, period: str, model: str | int, response: str = "corr_z") -> DataFrame:
    """ST5 for a registered model: OLS of scale(response) on the fixed part.
    Returns experiment, period, model, term, estimate, se, t, p_normal."""
    name, _ = model_formula(experiment, period, model)
    fit = cell_models.coefficients(df, registry_model(df, experiment, period, model, response))
    return fit.select(F.lit(experiment).alias("experiment"), F.lit(period).alias("period"), F.lit(name).alias("model"), "*")
