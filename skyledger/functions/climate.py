"""Climate estimated from latitude and elevation alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.functions.numeric import half_even

# The climate features, in their published order, with the
# number of decimals an estimate carries.
FEATURE_DIGITS = {
    "avg_temp_c": 1,
    "avg_summer_temp_c": 1,
    "avg_winter_temp_c": 1,
    "temp_variability": 1,
    "annual_precip_mm": 0,
    "annual_snowfall_mm": 0,
    "heat_days_per_year": 0,
    "cold_days_per_year": 0,
}
FEATURES = tuple(FEATURE_DIGITS)


# The coefficients and branch limits in `with_estimates`, which are those of the estimate.
def with_estimates(stations: DataFrame) -> DataFrame:
    """Add the eight features to stations with latitude and elevation.

    Each step is a column of its own, so later steps refer to it by name instead
    of repeating its expression. Every branch tests unrounded values; the
    features are rounded half to even at the end.
    """
    away, mean, winter = F.col("_away"), F.col("_mean"), F.col("_winter")
    half_swing = F.col("_half_swing")
    km_up = F.greatest(F.coalesce("elevation", F.lit(0.0)), F.lit(0.0)) / 1000.0
    steps = (
        {"_away": F.abs("latitude")},
        {
            "_mean": F.lit(27.0) - away * 0.45 - km_up * 6.5,
            "_half_swing": (F.lit(1.5) + away * 0.35) * 0.5,
        },
        {"_winter": mean - half_swing},
    )
    features = {
        "avg_temp_c": mean,
        "avg_summer_temp_c": mean + half_swing,
        "avg_winter_temp_c": winter,
        "temp_variability": F.greatest(
            F.lit(2.0) + away * 0.15 - away * away * 0.001, F.lit(1.0)
        ),
        "annual_precip_mm": F.greatest(
            F.when(away < 15, F.lit(1800.0) - away * 30.0)
            .when(away < 35, F.lit(400.0) + (away - 15.0) * 10.0)
            .when(away < 60, F.lit(600.0) + (F.lit(60.0) - away) * 15.0)
            .otherwise(F.lit(300.0) - (away - 60.0) * 3.0),
            F.lit(50.0),
        ),
        "annual_snowfall_mm": F.when(winter < -5, F.lit(800.0) + F.abs(winter) * 40.0)
        .when(winter < 3, F.lit(200.0) + (F.lit(3.0) - winter) * 80.0)
        .otherwise(F.lit(0.0)),
        "heat_days_per_year": F.when(mean > 25, (mean - 25.0) * 8.0).otherwise(F.lit(0.0)),
        "cold_days_per_year": F.when(winter < -15, (F.lit(-15.0) - winter) * 6.0).otherwise(
            F.lit(0.0)
        ),
    }
    rounded = {c: half_even(features[c], digits) for c, digits in FEATURE_DIGITS.items()}
    for step in (*steps, rounded):
        stations = stations.withColumns(step)
    return stations.drop("_away", "_mean", "_half_swing", "_winter")
