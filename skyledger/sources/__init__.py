"""Readers for fixed-width text, lookup tables and stored marts."""

from skyledger.sources.daily_text import landing_files, malformed_counts, parse_daily_lines, read_daily_files
from skyledger.sources.loaders import load_daily, load_features, load_monthly
from skyledger.sources.lookups import read_country_dim, state_dim
from skyledger.sources.station_text import parse_station_lines, read_station_catalogue

__all__ = [
    "landing_files",
    "load_daily",
    "load_features",
    "load_monthly",
    "malformed_counts",
    "parse_daily_lines",
    "parse_station_lines",
    "read_country_dim",
    "read_daily_files",
    "read_station_catalogue",
    "state_dim",
]
