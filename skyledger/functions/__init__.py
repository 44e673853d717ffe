"""Column functions. Every one returns a Column; none is a Python UDF."""

from skyledger.functions.climate import with_estimates
from skyledger.functions.geo import climate_zone, country_code, haversine_km, hemisphere
from skyledger.functions.numeric import half_even, mean_of_ticks, round_scaled, signless_zero
from skyledger.functions.text import blank_to_null, fixed, month_label, safe_double, try_int
from skyledger.functions.units import (
    c_to_f,
    delta_c_to_f,
    display_delta,
    display_temperature,
    f_to_c,
    rainfall,
)

__all__ = [
    "blank_to_null",
    "c_to_f",
    "climate_zone",
    "country_code",
    "delta_c_to_f",
    "display_delta",
    "display_temperature",
    "f_to_c",
    "fixed",
    "half_even",
    "haversine_km",
    "hemisphere",
    "mean_of_ticks",
    "month_label",
    "rainfall",
    "round_scaled",
    "safe_double",
    "signless_zero",
    "try_int",
    "with_estimates",
]
