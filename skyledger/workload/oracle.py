"""The registered queries again, as SQL for the checking engine.

Each statement starts from the base tables and is built from the named CTEs
below. Doubles are compared after rounding to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from skyledger.functions.climate import FEATURES
from skyledger.operators.climate import DEFAULT_PREFERENCES, RADAR_LABELS
from skyledger.operators.quality import MART_CHECKS, RAW_DAILY_CHECKS, STATION_CHECKS
from skyledger.sources.lookups import US_STATES
from skyledger.workload import params as p
from skyledger.workload.fixtures import (
    COUNTRY_CODES_SQL, FAR_STATIONS_SQL, ODD_DAILY_SQL, ODD_STATIONS_SQL, REPORTING_SQL, WIDE_REPORTING_SQL, oracle_ctes,
)


def rounded(expr: str, digits: int = 6) -> str:
    scaled = f"(round(({expr}) * 1e{digits}, 0) / 1e{digits})"
    return f"CASE WHEN {scaled} = 0 THEN 0e0 ELSE {scaled} END"


def half_even(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def shape(source: str, plain: Sequence[str], doubles: Sequence[str] = ()) -> str:
    parts = list(plain) + [f"{rounded(c)} AS {c}" for c in doubles]
    return f"SELECT {', '.join(parts)} FROM {source}"


def values(rows: Sequence[Sequence[str]], names: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


CTES = {
    "stg_daily": """
SELECT station_id, obs_date, hi/10e0 AS tmax_celsius, lo/10e0 AS tmin_celsius, av/10e0 AS tavg_celsius,
  CASE WHEN av IS NOT NULL THEN av/10e0 ELSE (hi+lo)/20e0 END AS tavg_derived_celsius,
  wet/10e0 AS precipitation_mm, CAST(snow AS DOUBLE) AS snowfall_mm, CAST(depth AS DOUBLE) AS snow_depth_mm,
  wind/10e0 AS avg_wind_speed_ms, (hi-lo)/10e0 AS temp_range_celsius
FROM (SELECT station_id, obs_date,
    max(data_value) FILTER (element='TMAX') AS hi, max(data_value) FILTER (element='TMIN') AS lo,
    max(data_value) FILTER (element='TAVG') AS av, max(data_value) FILTER (element='PRCP') AS wet,
    max(data_value) FILTER (element='SNOW') AS snow, max(data_value) FILTER (element='SNWD') AS depth,
    max(data_value) FILTER (element='AWND') AS wind
  FROM raw_daily WHERE q_flag IS NULL GROUP BY ALL)""",
    "stg_stations": """
SELECT *, station_id[1:2] AS country_code, if(latitude >= 0, 'Northern', 'Southern') AS hemisphere,
  if(abs(latitude) < 23.5, 'Tropical', if(abs(latitude) < 35, 'Subtropical', if(abs(latitude) < 55, 'Temperate',
    if(abs(latitude) < 66.5, 'Subarctic', 'Polar')))) AS climate_zone,
  starts_with(station_id, 'US') AS is_us_station
FROM raw_stations WHERE latitude + longitude IS NOT NULL""",
    "weather": """
SELECT s.station_id, s.station_name, s.latitude, s.longitude, s.elevation, s.state, s.country_code, s.climate_zone,
  o.obs_date, CAST(year(obs_date) AS INT) AS obs_year, CAST(month(obs_date) AS INT) AS obs_month,
  CAST(dayofweek(obs_date) AS INT) AS day_of_week, CAST(dayofyear(obs_date) AS INT) AS day_of_year,
  o.* EXCLUDE (station_id, obs_date, tavg_celsius),
  avg(tavg_derived_celsius) OVER last7 AS tavg_7d_avg, avg(precipitation_mm) OVER last7 AS precip_7d_avg,
  avg(tavg_derived_celsius) OVER last30 AS tavg_30d_avg, sum(precipitation_mm) OVER last30 AS precip_30d_total,
  tavg_derived_celsius - lag(tavg_derived_celsius) OVER past AS temp_change_1d,
  tavg_derived_celsius - lag(tavg_derived_celsius, 7) OVER past AS temp_change_7d,
  ifnull(precipitation_mm > 0, false) AS had_precipitation, ifnull(snowfall_mm > 0, false) AS had_snowfall,
  ifnull(tmax_celsius > 35, false) AS is_extreme_heat, ifnull(tmin_celsius < -20, false) AS is_extreme_cold
FROM stg_stations s, stg_daily o WHERE s.station_id = o.station_id
WINDOW past AS (PARTITION BY s.station_id ORDER BY o.obs_date),
  last7 AS (PARTITION BY s.station_id ORDER BY o.obs_date ROWS 6 PRECEDING),
  last30 AS (PARTITION BY s.station_id ORDER BY o.obs_date ROWS 29 PRECEDING)""",
    "monthly": f"""
SELECT station_id, station_name, latitude, longitude, state, country_code, climate_zone, obs_year, obs_month,
  {rounded("CAST(sum(CAST(round(tavg_derived_celsius*20) AS BIGINT)) AS DOUBLE)/20e0/nullif(count(tavg_derived_celsius), 0)", 2)} AS avg_temp_celsius,
  {rounded("max(tmax_celsius)", 2)} AS max_temp_celsius, {rounded("min(tmin_celsius)", 2)} AS min_temp_celsius,
  {rounded("stddev_samp(tavg_derived_celsius)", 2)} AS temp_stddev,
  {rounded("CAST(sum(CAST(round(ifnull(precipitation_mm, 0)*10) AS BIGINT)) AS DOUBLE)/10e0", 2)} AS total_precip_mm,
  count(*) FILTER (had_precipitation) AS days_with_precip,
  {rounded("CAST(sum(CAST(round(precipitation_mm*10) AS BIGINT)) FILTER (had_precipitation) AS DOUBLE)/10e0/nullif(count(*) FILTER (had_precipitation), 0)", 2)} AS avg_precip_per_rainy_day_mm,
  {rounded("CAST(sum(CAST(round(ifnull(snowfall_mm, 0)) AS BIGINT)) AS DOUBLE)", 2)} AS total_snowfall_mm,
  count(*) FILTER (had_snowfall) AS days_with_snow, count(*) FILTER (is_extreme_heat) AS extreme_heat_days,
  count(*) FILTER (is_extreme_cold) AS extreme_cold_days, count(*) AS observation_count,
  count(tavg_derived_celsius) AS temp_observation_count
FROM weather GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9""",
    "features": """
SELECT station_id, obs_date, obs_year, obs_month, day_of_year, latitude, longitude, elevation, climate_zone,
  lead(tavg_derived_celsius) OVER h AS target_tavg_next_day,
  tavg_derived_celsius, tmax_celsius, tmin_celsius, temp_range_celsius, precipitation_mm, snowfall_mm, avg_wind_speed_ms,
  lag(tavg_derived_celsius, 1) OVER h AS tavg_lag_1d, lag(tavg_derived_celsius, 2) OVER h AS tavg_lag_2d,
  lag(tavg_derived_celsius, 3) OVER h AS tavg_lag_3d, lag(tavg_derived_celsius, 7) OVER h AS tavg_lag_7d,
  lag(precipitation_mm, 1) OVER h AS precip_lag_1d, lag(precipitation_mm, 7) OVER h AS precip_lag_7d,
  tavg_7d_avg, tavg_30d_avg, precip_7d_avg, precip_30d_total, temp_change_1d, temp_change_7d,
  sin(2 * pi() * day_of_year / 365) AS season_sin, cos(2 * pi() * day_of_year / 365) AS season_cos,
  had_precipitation, had_snowfall, is_extreme_heat, is_extreme_cold
FROM weather WINDOW h AS (PARTITION BY station_id ORDER BY obs_date)
QUALIFY target_tavg_next_day IS NOT NULL AND tavg_lag_7d IS NOT NULL""",
    "states": f"SELECT * FROM {values(list(US_STATES.items()), 'code, name')}",
    "countries": f"SELECT * FROM {values(p.COUNTRIES, 'code, name, iso3')}",
    "available": """
SELECT station_id, station_name, latitude, longitude, elevation, climate_zone,
  bool_or(tavg_derived_celsius IS NOT NULL) AS has_temp
FROM weather GROUP BY ALL""",
    "found": f"""
SELECT DISTINCT ON (station_name, latitude, longitude, state, station_id[1:2])
  station_name AS name, latitude, longitude, state, station_id[1:2] AS cc
FROM stg_stations WHERE station_id[1:2] = '{p.COUNTRY}' AND contains(upper(station_name), upper('{p.SEARCH_TEXT}'))""",
    "points": p.POINTS_SQL.format(supplier="supplier"),
    "ticks": """
SELECT station_id, obs_year, obs_month, CAST(round(avg_temp_celsius*100) AS BIGINT) AS t,
  CAST(round(temp_stddev*100) AS BIGINT) AS sd, CAST(round(total_precip_mm*100) AS BIGINT) AS pr,
  CAST(round(total_snowfall_mm*100) AS BIGINT) AS sn, extreme_heat_days AS hot, extreme_cold_days AS cold
FROM monthly WHERE avg_temp_celsius IS NOT NULL""",
    "observed": """
SELECT station_id, CAST(sum(t) AS DOUBLE)/100e0/count(t) AS avg_temp_c,
  CAST(sum(t) FILTER (obs_month BETWEEN 6 AND 8) AS DOUBLE)/100e0/nullif(count(*) FILTER (obs_month BETWEEN 6 AND 8), 0) AS avg_summer_temp_c,
  CAST(sum(t) FILTER (obs_month IN (1, 2, 12)) AS DOUBLE)/100e0/nullif(count(*) FILTER (obs_month IN (1, 2, 12)), 0) AS avg_winter_temp_c,
  CAST(sum(sd) AS DOUBLE)/100e0/nullif(count(sd), 0) AS temp_variability,
  CAST(sum(pr) AS DOUBLE)/100e0/count(DISTINCT obs_year) AS annual_precip_mm,
  CAST(sum(sn) AS DOUBLE)/100e0/count(DISTINCT obs_year) AS annual_snowfall_mm,
  CAST(sum(hot) AS DOUBLE)/count(DISTINCT obs_year) AS heat_days_per_year,
  CAST(sum(cold) AS DOUBLE)/count(DISTINCT obs_year) AS cold_days_per_year
FROM ticks GROUP BY station_id HAVING count(*) >= 6""",
    "shape_of_earth": """
SELECT station_id, station_name, latitude, longitude, ifnull(elevation, 0) AS elevation, country_code, climate_zone,
  abs(latitude) AS a, 27e0 - abs(latitude)*0.45e0 - greatest(ifnull(elevation, 0), 0e0)/1000e0*6.5e0 AS m,
  1.5e0 + abs(latitude)*0.35e0 AS amp
FROM stg_stations""",
    "estimated": f"""
SELECT station_id, station_name, latitude, longitude, elevation, country_code, climate_zone,
  {half_even("m", 1)} AS avg_temp_c, {half_even("m + amp*0.5e0", 1)} AS avg_summer_temp_c,
  {half_even("m - amp*0.5e0", 1)} AS avg_winter_temp_c,
  {half_even("greatest(2e0 + a*0.15e0 - a*a*0.001e0, 1e0)", 1)} AS temp_variability,
  {half_even("greatest(CASE WHEN a >= 60 THEN 300e0 - (a-60e0)*3e0 WHEN a >= 35 THEN 600e0 + (60e0-a)*15e0 WHEN a >= 15 THEN 400e0 + (a-15e0)*10e0 ELSE 1800e0 - a*30e0 END, 50e0)", 0)} AS annual_precip_mm,
  {half_even("CASE WHEN m - amp*0.5e0 >= 3 THEN 0e0 WHEN m - amp*0.5e0 >= -5 THEN 200e0 + (3e0 - (m - amp*0.5e0))*80e0 ELSE 800e0 + abs(m - amp*0.5e0)*40e0 END", 0)} AS annual_snowfall_mm,
  {half_even("CASE WHEN m <= 25 THEN 0e0 ELSE (m - 25e0)*8e0 END", 0)} AS heat_days_per_year,
  {half_even("CASE WHEN m - amp*0.5e0 >= -15 THEN 0e0 ELSE (-15e0 - (m - amp*0.5e0))*6e0 END", 0)} AS cold_days_per_year,
  'estimated' AS data_source
FROM shape_of_earth""",
    "profiles": f"""
SELECT e.station_id, e.station_name, e.latitude, e.longitude, e.elevation, e.country_code, e.climate_zone,
  {', '.join(f'ifnull(o.{c}, e.{c}) AS {c}' for c in FEATURES)},
  if(o.station_id IS NULL, 'estimated', 'observed') AS data_source
FROM estimated e LEFT JOIN observed o ON o.station_id = e.station_id""",
    "bounds": "SELECT "
    + ", ".join(f"min({c}) AS {c}_low, max({c}) - min({c}) AS {c}_span" for c in FEATURES)
    + " FROM profiles",
    "scaled": "SELECT q.*, "
    + ", ".join(
        f"(q.{c} - {c}_low) / if({c}_span = 0, 1e0, {c}_span) AS v{i}, "
        f"({DEFAULT_PREFERENCES[c]}e0 - {c}_low) / if({c}_span = 0, 1e0, {c}_span) AS w{i}"
        for i, c in enumerate(FEATURES)
    )
    + " FROM profiles q, bounds",
    "scored": "SELECT *, ("
    + " + ".join(f"v{i}*w{i}" for i in range(8))
    + ") / CASE WHEN sqrt("
    + " + ".join(f"v{i}*v{i}" for i in range(8))
    + ") * sqrt("
    + " + ".join(f"w{i}*w{i}" for i in range(8))
    + ") = 0 THEN 1e0 ELSE sqrt("
    + " + ".join(f"v{i}*v{i}" for i in range(8))
    + ") * sqrt("
    + " + ".join(f"w{i}*w{i}" for i in range(8))
    + ") END AS similarity FROM scaled",
    "matches": f"SELECT *, {half_even('similarity * 100e0', 1)} AS similarity_pct FROM scored",
    "best": """
SELECT * FROM matches
QUALIFY row_number() OVER (PARTITION BY country_code ORDER BY similarity DESC, station_id) <= 3
ORDER BY similarity DESC, station_id LIMIT 20""",
    "cells": """
SELECT station_id, obs_date, element, max(data_value) AS data_value, max(m_flag) AS m_flag, max(q_flag) AS q_flag,
  max(s_flag) AS s_flag, CAST(NULL AS VARCHAR) AS obs_time
FROM raw_daily GROUP BY station_id, obs_date, element""",
    "batch": """
SELECT station_id, obs_date, element, data_value + 1 AS data_value, m_flag, q_flag, s_flag, obs_time
FROM raw_daily WHERE starts_with(station_id, 'US') AND year(obs_date) = 2023""",
}

#: Which CTEs a CTE reads, in the order they must be written.
NEEDS = {
    "weather": ("stg_daily", "stg_stations"),
    "monthly": ("weather",),
    "features": ("weather",),
    "available": ("weather",),
    "found": ("stg_stations",),
    "ticks": ("monthly",),
    "observed": ("ticks",),
    "shape_of_earth": ("stg_stations",),
    "estimated": ("shape_of_earth",),
    "profiles": ("estimated", "observed"),
    "bounds": ("profiles",),
    "scaled": ("profiles", "bounds"),
    "scored": ("scaled",),
    "matches": ("scored",),
    "best": ("matches",),
}


#: Raw observations after a text round trip of all years, or of 2024 alone.
AS_TEXT = "SELECT station_id, obs_date, element, max(data_value) AS data_value, max(q_flag) AS q_flag FROM derived_daily {where} GROUP BY ALL"
AFTER_BACKFILL = AS_TEXT.format(where="")
AFTER_REFRESH = (
    "SELECT station_id, obs_date, element, data_value, q_flag FROM derived_daily WHERE year(obs_date) < 2024 "
    "UNION ALL " + AS_TEXT.format(where="WHERE year(obs_date) = 2024")
)


def statement(
    body: str, *needs: str, raw_daily: str | None = None, reporting: str = REPORTING_SQL
) -> str:
    """``body`` with the CTEs it needs; ``raw_daily`` stands in for the raw table."""
    order: list[str] = []

    def visit(name: str) -> None:
        for below in NEEDS.get(name, ()):
            visit(below)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    base = [oracle_ctes(reporting=reporting)]
    if raw_daily is not None:
        base = [oracle_ctes("derived_daily", reporting), f"raw_daily AS ({raw_daily})"]
    ctes = ", ".join([*base, *[f"{name} AS ({CTES[name]})" for name in order]])
    return f"WITH {ctes} {body}"


KEYS = ("station_id", "station_name", "obs_date")
STATION = ("station_id", "station_name", "state", "country_code", "climate_zone")
MEASURES = (
    "tmax_celsius", "tmin_celsius", "tavg_derived_celsius", "temp_range_celsius",
    "precipitation_mm", "snowfall_mm", "avg_wind_speed_ms",
)
ROLLING = (
    "tavg_7d_avg", "precip_7d_avg", "tavg_30d_avg", "precip_30d_total", "temp_change_1d", "temp_change_7d",
)
FLAGS = ("had_precipitation", "had_snowfall", "is_extreme_heat", "is_extreme_cold")
MONTH_DOUBLES = (
    "avg_temp_celsius", "max_temp_celsius", "min_temp_celsius", "temp_stddev",
    "total_precip_mm", "avg_precip_per_rainy_day_mm", "total_snowfall_mm",
)
MONTH_COUNTS = (
    "days_with_precip", "days_with_snow", "extreme_heat_days", "extreme_cold_days",
    "observation_count", "temp_observation_count",
)
PLACE = ("latitude", "longitude", "elevation")


def _check_rows(checks, metrics: dict[str, tuple[str, str, str]]) -> str:
    """Result rows from (metric, pass condition, warn condition) per check; ``m`` is the metric."""
    parts = []
    for check in checks:
        metric, passes, warns = metrics[check.name]
        result = f"CASE WHEN {passes} THEN 'PASS' WHEN {warns} THEN 'WARN' ELSE 'FAIL' END"
        parts.append(
            f"SELECT '{check.name}' AS check_name, CAST(ifnull(m, -1) AS BIGINT) AS violation_count, "
            f"{result} AS check_result, '{check.description}' AS description FROM (SELECT ({metric}) AS m)"
        )
    return " UNION ALL ".join(parts)


ZERO, NEVER = "m = 0", "false"
DAY = f"DATE '{p.AS_OF}'"
RAW_QUALITY = _check_rows(
    RAW_DAILY_CHECKS,
    {
        "null_station_id": ("SELECT count(*) FROM raw_daily WHERE station_id IS NULL", ZERO, NEVER),
        "null_obs_date": ("SELECT count(*) FROM raw_daily WHERE obs_date IS NULL", ZERO, NEVER),
        "future_dates": (f"SELECT count(*) FROM raw_daily WHERE obs_date > {DAY}", ZERO, "m < 100"),
        "extreme_temperatures": (
            "SELECT count(*) FROM raw_daily WHERE element IN ('TMAX', 'TMIN', 'TAVG') AND data_value NOT BETWEEN -900 AND 600",
            ZERO,
            "m < 50",
        ),
        "negative_precipitation": (
            "SELECT count(*) FROM raw_daily WHERE element = 'PRCP' AND data_value < 0",
            ZERO,
            NEVER,
        ),
        "temp_max_less_than_min": (
            "SELECT count(*) FROM (SELECT max(data_value) FILTER (element='TMAX') AS hi, "
            "max(data_value) FILTER (element='TMIN') AS lo FROM raw_daily GROUP BY station_id, obs_date) WHERE hi < lo",
            ZERO,
            "m < 100",
        ),
        "data_freshness": (f"SELECT {DAY} - max(obs_date) FROM raw_daily", "m <= 7", "m <= 30"),
        "orphan_stations": (
            "SELECT count(DISTINCT station_id) FROM raw_daily WHERE station_id NOT IN (SELECT station_id FROM raw_stations)",
            ZERO,
            "m < 50",
        ),
    },
)
STATION_QUALITY = _check_rows(
    STATION_CHECKS,
    {
        "latitude_out_of_range": (
            "SELECT count(*) FROM raw_stations WHERE latitude NOT BETWEEN -90 AND 90",
            ZERO,
            NEVER,
        ),
        "longitude_out_of_range": (
            "SELECT count(*) FROM raw_stations WHERE longitude NOT BETWEEN -180 AND 180",
            ZERO,
            NEVER,
        ),
        "duplicate_station_ids": (
            "SELECT count(*) FROM (SELECT count(*) AS n FROM raw_stations GROUP BY station_id) WHERE n > 1",
            ZERO,
            NEVER,
        ),
        "us_station_coverage": (
            "SELECT count(*) FROM raw_stations WHERE starts_with(station_id, 'US')",
            "m > 5000",
            "m > 1000",
        ),
        "elevation_out_of_range": (
            "SELECT count(*) FROM raw_stations WHERE elevation NOT BETWEEN -500 AND 9000",
            ZERO,
            "m < 10",
        ),
    },
)
MART_QUALITY = _check_rows(
    MART_CHECKS,
    {
        "mart_daily_weather_populated": ("SELECT count(*) FROM weather", "m > 0", NEVER),
        "rolling_averages_computed": ("SELECT count(tavg_7d_avg) FROM weather", "m > 0", NEVER),
        "prediction_targets_exist": ("SELECT count(*) FROM features", "m > 1000", "m > 0"),
        "monthly_summary_coverage": (
            "SELECT count(DISTINCT (obs_year, obs_month)) FROM monthly",
            "m >= 12",
            "m > 2",
        ),
        "stations_joined_correctly": (
            "SELECT count(*) - count(station_name) FROM weather",
            ZERO,
            "m < 100",
        ),
    },
)


def _rules(table: str, no_failures: bool) -> str:
    sql = (
        f"SELECT '{table}' AS table_name, 'check_name:not_null' AS rule, count(*) - count(check_name) AS observed, "
        f"CAST(0 AS BIGINT) AS expected, count(*) = count(check_name) AS holds FROM {table} "
        f"UNION ALL SELECT '{table}', 'check_result:not_null', count(*) - count(check_result), 0, "
        f"count(*) = count(check_result) FROM {table} "
        f"UNION ALL SELECT '{table}', 'check_result:accepted_values', "
        f"count(*) FILTER (check_result NOT IN ('PASS', 'WARN', 'FAIL')), 0, "
        f"count(*) FILTER (check_result NOT IN ('PASS', 'WARN', 'FAIL')) = 0 FROM {table}"
    )
    if no_failures:
        fails = "count(*) FILTER (check_result = 'FAIL')"
        sql += (
            f" UNION ALL SELECT '{table}', 'no_failures', if({fails} = 0, 1, 0), 1, {fails} = 0 FROM {table}"
        )
    return sql


def great_circle(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"pow(sin(radians({lat2} - {lat1})/2), 2) + cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin(radians({lon2} - {lon1})/2), 2)"
    )
    return f"2*6371e0*atan2(sqrt({a}), sqrt(greatest(1 - ({a}), 0)))"


def near(lat: str, lon: str, radius: str) -> str:
    reach = f"({radius}/111e0 + 0.5e0)"
    return (
        f"abs(s.latitude - {lat}) <= {reach} AND abs(s.longitude - {lon}) <= {reach} "
        f"AND {great_circle(lat, lon, 's.latitude', 's.longitude')} <= {radius}"
    )


LAT, LON = (f"{x}e0" for x in p.POINT)
DISTANCE = half_even(great_circle(LAT, LON, "s.latitude", "s.longitude"), 1)
FOUND_LABEL = """
SELECT f.name, concat_ws(', ', f.name, if(f.state <> '', ifnull(st.name, f.state), NULL), ifnull(co.name, f.cc)) AS display,
  f.latitude, f.longitude
FROM found f LEFT JOIN states st ON st.code = f.state LEFT JOIN countries co ON co.code = f.cc
ORDER BY f.name, f.latitude, f.longitude, f.state"""
ANCHOR = "(SELECT latitude AS la, longitude AS lo FROM found ORDER BY name, latitude, longitude, state LIMIT 1)"
US_2024 = "station_id IN (SELECT station_id FROM raw_stations WHERE station_id[1:2] = 'US') AND obs_year = 2024"
RAW = "station_id, obs_date, element, CAST(data_value AS INT) AS data_value, m_flag, q_flag, s_flag, obs_time"
RAIN = "greatest(ifnull(precipitation_mm, 0) - ifnull(snowfall_mm, 0), 0)"
MONTH_RAIN = "greatest(ifnull(total_precip_mm, 0) - ifnull(total_snowfall_mm, 0), 0)"
LABEL = "CAST(obs_year AS VARCHAR) || '-' || lpad(CAST(obs_month AS VARCHAR), 2, '0')"


def long_form(source: str, keys: str, series: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{name}' AS series, {rounded(expr)} AS value FROM {source}"
        for name, expr in series.items()
    )


def fahrenheit(c: str) -> str:
    return f"({c})*9e0/5e0 + 32e0"


def counts(**tables: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name.replace('__', '.')}' AS table_name, count(*) AS rows FROM {source}"
        for name, source in tables.items()
    )


MART_TABLES = {
    "staging__daily_observations": "stg_daily",
    "staging__stations": "stg_stations",
    "marts__daily_weather": "weather",
    "marts__monthly_summary": "monthly",
    "marts__prediction_features": "features",
}
FIRST = "(SELECT * FROM features WHERE station_id = (SELECT min(station_id) FROM features))"


#: Outcome of every station that one of four ways of naming a location asks for.
INGEST_LOCATION = f"""
, loaded AS (
  SELECT station_id, count(*) AS rows FROM (SELECT DISTINCT station_id, obs_date, element FROM raw_daily WHERE year(obs_date) = 2024)
  GROUP BY station_id
), old AS (
  SELECT station_id FROM raw_stations WHERE gsn_flag IS NOT NULL AND wmo_id IS NOT NULL
), ids AS (
  SELECT min(station_id) AS station_id FROM raw_stations WHERE station_id IN (SELECT station_id FROM raw_daily)
  UNION ALL SELECT min(station_id) FROM old WHERE station_id NOT IN (SELECT station_id FROM raw_daily)
  UNION ALL SELECT min(station_id) FROM raw_stations
    WHERE station_id NOT IN (SELECT station_id FROM raw_daily) AND station_id NOT IN (SELECT station_id FROM old)
), wanted AS (
  SELECT 'ids' AS chosen_by, station_id FROM ids
  UNION ALL SELECT 'state', station_id FROM raw_stations WHERE state = '{p.STATE}'
  UNION ALL SELECT 'country', station_id FROM raw_stations WHERE station_id LIKE '{p.COUNTRY}%'
  UNION ALL SELECT 'point', station_id FROM raw_stations s WHERE {near(LAT, LON, f'{p.RADIUS_KM}e0')}
)
SELECT chosen_by, station_id, ifnull(rows, 0) AS rows,
  CASE WHEN rows > 0 THEN 'loaded' WHEN station_id IN (SELECT station_id FROM old)
    OR station_id IN (SELECT station_id FROM raw_daily) THEN 'skipped' ELSE 'errors' END AS outcome
FROM wanted LEFT JOIN loaded USING (station_id)
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["stage_daily"] = statement(
        shape("stg_daily", ("station_id", "obs_date"), (*MEASURES, "tavg_celsius", "snow_depth_mm")),
        "stg_daily",
    )
    q["stage_stations"] = statement(
        shape(
            "stg_stations",
            (*STATION, "gsn_flag", "hcn_flag", "wmo_id", "hemisphere", "is_us_station"),
            PLACE,
        ),
        "stg_stations",
    )
    lags = [f"tavg_lag_{n}d" for n in (1, 2, 3, 7)] + ["precip_lag_1d", "precip_lag_7d"]
    mart_shapes = {
        "mart_daily_weather": (
            "weather",
            (*STATION, "obs_date", "obs_year", "obs_month", "day_of_week", "day_of_year", *FLAGS),
            (*PLACE, *MEASURES, "snow_depth_mm", *ROLLING),
        ),
        "mart_monthly_summary": (
            "monthly",
            (*STATION, "obs_year", "obs_month", *MONTH_COUNTS),
            ("latitude", "longitude", *MONTH_DOUBLES),
        ),
        "mart_prediction_features": (
            "features",
            ("station_id", "obs_date", "obs_year", "obs_month", "day_of_year", "climate_zone", *FLAGS),
            (*PLACE, "target_tavg_next_day", *MEASURES, *lags, *ROLLING, "season_sin", "season_cos"),
        ),
    }
    for name, (source, plain, doubles) in mart_shapes.items():
        q[name] = statement(shape(source, plain, doubles), source)
        q[f"{name}_wide"] = statement(
            shape(source, plain, doubles), source, reporting=WIDE_REPORTING_SQL
        )

    q["quality_raw"] = statement(RAW_QUALITY)
    q["quality_stations"] = statement(STATION_QUALITY)
    q["quality_marts"] = statement(MART_QUALITY, "monthly", "features")
    results = (
        f"SELECT * FROM (WITH q_raw AS ({RAW_QUALITY}), q_stations AS ({STATION_QUALITY}), q_marts AS ({MART_QUALITY}) "
        f"{_rules('q_raw', True)} UNION ALL {_rules('q_stations', False)} UNION ALL {_rules('q_marts', True)})"
    )
    q["quality_column_checks"] = statement(results, "monthly", "features")
    q["duplicate_stations"] = statement(
        "SELECT station_id, count(*) AS occurrences FROM raw_stations GROUP BY ALL HAVING count(*) > 1"
    )

    q["states_available"] = statement(
        "SELECT r.code, ifnull(s.name, r.code) || ' (' || r.code || ')' AS display FROM (SELECT DISTINCT state AS code "
        "FROM raw_stations WHERE station_id LIKE 'US%' AND state <> '') r LEFT JOIN states s ON s.code = r.code",
        "states",
    )
    q["countries_available"] = statement(
        "SELECT r.code, ifnull(c.name, r.code) || ' (' || ifnull(c.iso3, r.code) || ')' AS display "
        "FROM (SELECT DISTINCT station_id[1:2] AS code FROM raw_stations) r LEFT JOIN countries c ON c.code = r.code",
        "countries",
    )
    q["stations_for_state"] = statement(f"SELECT station_id FROM raw_stations WHERE state = '{p.STATE}'")
    q["stations_for_country"] = statement(
        f"SELECT station_id FROM raw_stations WHERE station_id[1:2] = '{p.COUNTRY}'"
    )
    q["station_names"] = statement(
        f"SELECT station_id, station_name FROM raw_stations WHERE state = '{p.STATE}' AND station_id LIKE 'US%'"
    )
    q["station_places"] = statement(
        f"SELECT DISTINCT station_name AS name, {rounded('latitude')} AS latitude, {rounded('longitude')} AS longitude "
        f"FROM stg_stations WHERE country_code = '{p.COUNTRY}'",
        "stg_stations",
    )
    q["station_search"] = statement(
        f"SELECT name, display, {rounded('latitude')} AS latitude, {rounded('longitude')} AS longitude "
        f"FROM ({FOUND_LABEL} LIMIT 50)",
        "found",
        "states",
        "countries",
    )
    one = "(SELECT min(station_id) AS id FROM raw_stations)"
    q["station_coordinates"] = statement(
        f"SELECT {rounded('latitude')} AS latitude, {rounded('longitude')} AS longitude "
        f"FROM raw_stations, {one} WHERE station_id = id"
    )
    q["stations_near_point"] = statement(
        f"SELECT station_id, station_name, {rounded('latitude')} AS latitude, {rounded('longitude')} AS longitude, "
        f"{DISTANCE} AS distance_km FROM raw_stations s WHERE {near(LAT, LON, f'{p.RADIUS_KM}e0')}"
    )
    q["search_then_radius"] = statement(
        f"SELECT s.station_id, {half_even(great_circle('a.la', 'a.lo', 's.latitude', 's.longitude'), 1)} AS distance_km "
        f"FROM raw_stations s, {ANCHOR} a WHERE {near('a.la', 'a.lo', f'{p.RADIUS_KM}e0')}",
        "found",
    )
    q["radius_batch"] = statement(
        f"SELECT t.point_id, s.station_id, "
        f"{half_even(great_circle('t.latitude', 't.longitude', 's.latitude', 's.longitude'), 1)} AS distance_km "
        f"FROM points t, raw_stations s WHERE {near('t.latitude', 't.longitude', 't.radius_km')}",
        "points",
    )
    between = great_circle("t.latitude", "t.longitude", "s.latitude", "s.longitude")
    q["radius_batch_relaxed"] = statement(
        f"SELECT t.point_id, s.station_id, {half_even(between, 1)} AS distance_km "
        f"FROM points t, raw_stations s WHERE {between} <= t.radius_km",
        "points",
    )
    q["resolve_stations"] = statement(
        f"SELECT 'state' AS chosen_by, station_id FROM raw_stations WHERE state = '{p.STATE}' "
        f"UNION ALL SELECT 'country', station_id FROM raw_stations WHERE station_id LIKE '{p.COUNTRY}%' "
        f"UNION ALL SELECT 'point', station_id FROM raw_stations s WHERE {near(LAT, LON, f'{p.RADIUS_KM}e0')}"
    )
    selection = ("station_id", "station_name", "climate_zone", "has_temp")
    q["available_stations"] = statement(shape("available", selection, PLACE), "available")
    q["default_selection"] = statement(
        shape(
            "(SELECT * FROM available WHERE has_temp OR NOT (SELECT bool_or(has_temp) FROM available) "
            "ORDER BY station_name, station_id LIMIT 3)",
            selection,
            PLACE,
        ),
        "available",
    )
    q["restrict_to_selection"] = statement(
        shape(
            f"(SELECT * FROM available WHERE station_id[1:2] = '{p.COUNTRY}')", selection, PLACE
        ),
        "available",
    )
    q["capped_sample"] = statement(
        "SELECT station_id FROM raw_stations ORDER BY starts_with(station_id, 'US1'), "
        f"md5(station_id || '{p.SAMPLE_SEED}'), station_id LIMIT {p.SAMPLE_SIZE}"
    )

    profile = ("station_id", "station_name", "country_code", "climate_zone", "data_source")
    q["estimated_climate"] = statement(shape("estimated", profile, (*PLACE, *FEATURES)), "estimated")
    q["observed_climate"] = statement(shape("observed", ("station_id",), FEATURES), "observed")
    q["climate_profiles"] = statement(shape("profiles", profile, (*PLACE, *FEATURES)), "profiles")
    q["source_counts"] = statement(
        "SELECT data_source, count(*) AS stations FROM profiles GROUP BY data_source", "profiles"
    )
    scores = ("similarity", "similarity_pct")
    q["climate_similarity"] = statement(
        shape("matches", profile, (*PLACE, *FEATURES, *scores)), "matches"
    )
    q["diverse_top"] = statement(shape("best", profile, (*FEATURES, *scores)), "best")
    shown = [c for c in FEATURES if c != "temp_variability"]
    q["match_table"] = statement(
        "SELECT station_name, ifnull(c.name, country_code) AS country, climate_zone, data_source, similarity_pct, "
        + ", ".join(
            f"{rounded(half_even(fahrenheit(c) if '_temp_' in c else c, 1))} AS {c}" for c in shown
        )
        + " FROM best LEFT JOIN countries c ON c.code = country_code",
        "best",
        "countries",
    )
    label = "station_name || ' (' || CAST(similarity_pct AS VARCHAR) || '%)'"
    q["radar_frame"] = statement(
        " UNION ALL ".join(
            f"SELECT 'Your preference' AS series, '{RADAR_LABELS[c]}' AS feature, {rounded(f'w{i}')} AS value "
            f"FROM (SELECT DISTINCT w{i} FROM scaled) UNION ALL SELECT {label}, '{RADAR_LABELS[c]}', {rounded(f'v{i}')} "
            f"FROM (SELECT * FROM best ORDER BY similarity DESC, station_id LIMIT 3)"
            for i, c in enumerate(FEATURES)
        ),
        "best",
    )

    q["load_daily_for_country"] = statement(
        shape(
            f"(SELECT * FROM weather WHERE {US_2024})",
            ("station_id", "station_name", "obs_date", "obs_year", "obs_month", *FLAGS),
            (*MEASURES, "tavg_7d_avg", "tavg_30d_avg", "precip_7d_avg", "precip_30d_total", "temp_change_1d"),
        ),
        "weather",
    )
    q["load_monthly_for_country"] = statement(
        shape(
            f"(SELECT *, {LABEL} AS month_label FROM monthly WHERE {US_2024} AND avg_temp_celsius IS NOT NULL)",
            (*STATION, "obs_year", "obs_month", "month_label", *MONTH_COUNTS),
            ("latitude", "longitude", *MONTH_DOUBLES),
        ),
        "monthly",
    )
    q["load_features_for_country"] = statement(
        shape(
            f"(SELECT * FROM features WHERE {US_2024})",
            ("station_id", "obs_date"),
            (
                "tavg_derived_celsius", "target_tavg_next_day", "tavg_lag_1d", "tavg_lag_7d", "tavg_7d_avg",
                "tavg_30d_avg", "precipitation_mm", "precip_lag_1d", "temp_change_1d", "temp_change_7d",
                "season_sin", "season_cos",
            ),
        ),
        "features",
    )

    keys = ", ".join(KEYS)
    lines = {"max": "tmax_celsius", "min": "tmin_celsius", "7d avg": "tavg_7d_avg"}
    q["frame_temperature"] = statement(long_form("weather", keys, lines), "weather")
    q["frame_temperature_fahrenheit"] = statement(
        long_form("weather", keys, {k: fahrenheit(v) for k, v in lines.items()}), "weather"
    )
    q["frame_temperature_change"] = statement(
        f"SELECT {keys}, {rounded('temp_change_1d*9e0/5e0')} AS temp_change FROM weather", "weather"
    )
    q["frame_precipitation"] = statement(
        f"SELECT {keys}, {rounded('precipitation_mm')} AS precipitation_mm, {rounded(RAIN)} AS rainfall_mm, "
        f"{rounded('precip_30d_total')} AS precip_30d_total FROM weather",
        "weather",
    )
    q["frame_snowfall"] = statement(
        f"SELECT {keys}, {rounded('snowfall_mm')} AS snowfall_mm FROM weather WHERE had_snowfall", "weather"
    )
    months = {
        "avg_temp": "avg_temp_celsius", "total_precip_mm": "total_precip_mm", "rainfall_mm": MONTH_RAIN,
        "extreme_heat_days": "CAST(extreme_heat_days AS DOUBLE)",
        "extreme_cold_days": "CAST(extreme_cold_days AS DOUBLE)", "total_snowfall_mm": "total_snowfall_mm",
    }
    q["frame_monthly"] = statement(
        long_form(
            "(SELECT * FROM monthly WHERE avg_temp_celsius IS NOT NULL)",
            f"station_id, station_name, {LABEL} AS month_label",
            months,
        ),
        "monthly",
    )
    q["frame_target"] = statement(
        long_form(
            "(SELECT f.*, ifnull(n.name, f.station_id) AS station_name FROM features f LEFT JOIN "
            "(SELECT station_id, min(station_name) AS name FROM weather GROUP BY ALL) n USING (station_id))",
            keys,
            {"actual": "tavg_derived_celsius", "next-day target": "target_tavg_next_day"},
        ),
        "features",
    )
    lagged = ("tavg_derived_celsius", "tavg_lag_1d", "tavg_lag_7d", "tavg_7d_avg", "tavg_30d_avg")
    q["frame_lags"] = statement(long_form(FIRST, "obs_date", {c: c for c in lagged}), "features")
    q["frame_seasonal"] = statement(
        long_form(FIRST, "obs_date", {c: c for c in ("season_sin", "season_cos")}), "features"
    )

    q["dly_roundtrip"] = statement(f"SELECT {RAW} FROM cells", "cells")
    q["stream_ingest"] = q["dly_roundtrip"]
    q["catalogue_roundtrip"] = statement(
        "SELECT station_id, state, station_name, gsn_flag, hcn_flag, wmo_id, "
        + ", ".join(
            f"{rounded(e)} AS {c}"
            for c, e in {"latitude": "latitude", "longitude": "longitude", "elevation": "floor(elevation)"}.items()
        )
        + " FROM stg_stations",
        "stg_stations",
    )
    q["replace_station_years"] = statement(
        f"SELECT {RAW} FROM raw_daily r WHERE NOT (station_id IN (SELECT station_id FROM batch) "
        f"AND year(obs_date) IN (2023, 2024)) UNION ALL SELECT {RAW} FROM batch",
        "batch",
    )
    q["replace_years"] = statement(
        f"SELECT {RAW} FROM raw_daily WHERE year(obs_date) <> 2023 UNION ALL SELECT {RAW} FROM batch", "batch"
    )
    q["force_reload"] = statement(f"SELECT {RAW} FROM batch", "batch")
    q["append_batch"] = statement(
        f"SELECT {RAW} FROM raw_daily UNION ALL SELECT {RAW} FROM batch", "batch"
    )
    q["station_full_replace"] = statement(
        shape("stg_stations", ("station_id", "state", "station_name", "gsn_flag", "hcn_flag", "wmo_id"), PLACE),
        "stg_stations",
    )
    q["already_ingested"] = statement(
        "SELECT station_id FROM raw_daily WHERE year(obs_date) BETWEEN 2023 AND 2024 GROUP BY station_id "
        "HAVING min(year(obs_date)) = 2023 AND max(year(obs_date)) = 2024"
    )
    q["ingest_outcomes"] = statement(
        "SELECT count(*) FILTER (r) AS loaded, count(*) FILTER (f AND NOT r) AS skipped, count(*) FILTER (NOT f AND NOT r) AS errors "
        "FROM (SELECT s.station_id IN (SELECT station_id FROM raw_daily) AS r, "
        "(s.wmo_id IS NOT NULL OR s.station_id IN (SELECT station_id FROM raw_daily)) AS f FROM raw_stations s)"
    )
    q["populated"] = statement(
        "SELECT *, rows > 0 AS populated FROM ("
        + counts(raw__stations="raw_stations", raw__daily="raw_daily", marts__daily_weather="weather")
        + ")",
        "weather",
    )
    q["run_transforms_counts"] = statement(counts(**MART_TABLES), "monthly", "features")
    for name, raw in (("backfill_counts", AFTER_BACKFILL), ("refresh_counts", AFTER_REFRESH)):
        q[name] = statement(
            counts(raw__daily="raw_daily", **MART_TABLES), "monthly", "features", raw_daily=raw
        )
    for way, raw in (("stored", None), ("backfilled", AFTER_BACKFILL), ("refreshed", AFTER_REFRESH)):
        for name, (source, plain, doubles) in mart_shapes.items():
            stored = f"{way}_{name.removeprefix('mart_')}"
            q[stored] = statement(shape(source, plain, doubles), source, raw_daily=raw)
    q["stored_quality_raw_daily"] = q["quality_raw"]
    q["stored_quality_stations"] = q["quality_stations"]
    q["stored_quality_marts"] = q["quality_marts"]
    q["stream_ingest_files"] = q["dly_roundtrip"]
    q["countries_from_files"] = statement(
        "SELECT r.code, ifnull(c.name, r.code) || ' (' || ifnull(c.iso3, r.code) || ')' AS display "
        f"FROM (SELECT DISTINCT station_id[1:2] AS code FROM ({FAR_STATIONS_SQL.format(raw_stations='raw_stations')})) r "
        f"LEFT JOIN ({COUNTRY_CODES_SQL.format(customer='customer')}) c ON c.code = r.code"
    )
    q["available_stations_stored"] = statement(
        shape("available", selection, PLACE), "available", raw_daily=AFTER_REFRESH
    )
    q["ingest_location"] = statement(INGEST_LOCATION)
    odd_daily = f", odd_daily AS ({ODD_DAILY_SQL.format(raw_daily='raw_daily')}) "
    odd_stations = f", odd_stations AS ({ODD_STATIONS_SQL.format(raw_stations='raw_stations')}) "
    q["quality_raw_odd"] = statement(odd_daily + RAW_QUALITY.replace("raw_daily", "odd_daily"))
    q["quality_stations_odd"] = statement(odd_stations + STATION_QUALITY.replace("raw_stations", "odd_stations"))
    q["duplicate_stations_odd"] = statement(
        odd_stations + "SELECT station_id, count(*) AS occurrences FROM odd_stations GROUP BY ALL HAVING count(*) > 1"
    )
    q["search_without_match"] = statement(
        f"SELECT station_id, CAST(NULL AS DOUBLE) AS distance_km FROM raw_stations WHERE station_id LIKE '{p.COUNTRY}%'"
    )
    q["coordinates_of_unknown_station"] = "SELECT 0e0 AS latitude, 0e0 AS longitude"
    q["malformed_report"] = statement(
        "SELECT count(*) FILTER (WHERE m = 3) AS bad_years, count(*) FILTER (WHERE m = 5) AS bad_months, "
        "count(*) FILTER (WHERE m = 7) AS bad_values FROM (SELECT DISTINCT station_id, element, "
        "year(obs_date) AS y, month(obs_date) AS m FROM raw_daily)"
    )
    q["backfilled_without_malformed"] = statement(
        f"SELECT {RAW} FROM cells WHERE month(obs_date) NOT IN (3, 5) AND NOT (month(obs_date) = 7 AND day(obs_date) = 1)",
        "cells",
    )
    return q
