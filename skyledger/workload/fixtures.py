"""Weather-shaped raw tables derived from the provided star-schema tables.

The same SQL text runs in Spark and in the checking engine. Stations come from
``customer``, observations from ``lineitem``. The number of reporting stations
grows with the tables (one per 125 customers, twelve at least), so station-days
grow with them too and their density stays the same at every scale.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_STATIONS_SQL = """
SELECT station_id, latitude, longitude, elevation,
  CASE WHEN substr(station_id,1,2)='US' THEN state END AS state, station_name,
  CASE WHEN k % 11 = 0 THEN 'GSN' END AS gsn_flag, CASE WHEN k % 13 = 0 THEN 'HCN' END AS hcn_flag,
  CASE WHEN k % 5 = 0 THEN lpad(CAST(k AS STRING),5,'0') END AS wmo_id
FROM (SELECT c_custkey AS k,
  CASE CAST(c_nationkey AS INT) % 8 WHEN 0 THEN 'US' WHEN 1 THEN 'CA' WHEN 2 THEN 'GM' WHEN 3 THEN 'NO'
    WHEN 4 THEN 'AS' WHEN 5 THEN 'US' WHEN 6 THEN 'BR' ELSE 'RS' END
    || lpad(CAST(c_custkey AS STRING),9,'0') AS station_id,
  CASE WHEN c_custkey % 97 = 96 THEN NULL ELSE CAST((c_custkey*7919) % 18001 AS DOUBLE)/100 - 90 END AS latitude,
  CAST((c_custkey*10473) % 36001 AS DOUBLE)/100 - 180 AS longitude,
  CASE WHEN c_custkey % 17 = 16 THEN NULL ELSE c_acctbal END AS elevation,
  CASE c_custkey % 4 WHEN 0 THEN 'AK' WHEN 1 THEN 'WA' WHEN 2 THEN 'TX' ELSE 'NY' END AS state,
  upper(c_mktsegment) || ' ' || CAST(c_custkey % 50 AS STRING) AS station_name
  FROM {customer}) t
"""

#: Number of stations that report, as an expression over ``customer``.
REPORTING_SQL = "(SELECT greatest(12, CAST(floor(count(*) / 125) AS BIGINT)) FROM {customer})"

#: Bench variant: many more, sparser stations.
WIDE_REPORTING_SQL = "(SELECT greatest(1000, CAST(floor(count(*) / 15) AS BIGINT)) FROM {customer})"

RAW_DAILY_SQL = """
SELECT coalesce(s.station_id, 'ZZ' || lpad(CAST(r.k AS STRING),9,'0')) AS station_id, r.obs_date, r.element,
  r.data_value, r.m_flag, r.q_flag, r.s_flag, CAST(NULL AS STRING) AS obs_time
FROM (SELECT l_orderkey % {reporting} AS k,
  DATE '2023-01-01' + CAST((l_orderkey*7 + l_partkey*3 + l_suppkey) % 730 AS INT) AS obs_date,
  CASE l_linenumber WHEN 1 THEN 'TMAX' WHEN 2 THEN 'TMIN' WHEN 3 THEN 'TAVG' WHEN 4 THEN 'PRCP'
    WHEN 5 THEN 'SNOW' WHEN 6 THEN 'SNWD' ELSE 'AWND' END AS element,
  CASE WHEN l_linenumber=1 AND (l_orderkey + l_partkey) % 997 = 0 THEN 950
       WHEN l_linenumber=4 AND (l_orderkey + l_partkey) % 991 = 0 THEN -5
       WHEN l_linenumber=1 THEN CAST(l_quantity AS INT)*12 - 150
       WHEN l_linenumber=2 THEN CAST(l_quantity AS INT)*12 - 350
       WHEN l_linenumber=3 THEN CAST(l_quantity AS INT)*12 - 250
       WHEN l_linenumber=4 THEN greatest(CAST(l_quantity AS INT)*8 - 200, 0)
       WHEN l_linenumber=5 THEN greatest(CAST(l_quantity AS INT) - 35, 0)
       WHEN l_linenumber=6 THEN CAST(l_quantity AS INT)
       ELSE CAST(l_quantity AS INT)*3 END AS data_value,
  CASE WHEN l_partkey % 19 = 0 THEN 'T' END AS m_flag,
  CASE WHEN (l_orderkey*31 + l_linenumber*17 + l_partkey) % 40 = 0 THEN 'G' END AS q_flag,
  l_returnflag AS s_flag
  FROM {lineitem}) r
LEFT JOIN {raw_stations} s ON CAST(substr(s.station_id,3,9) AS BIGINT) = CASE r.k WHEN 11 THEN -11 ELSE r.k END
"""


# Declared types of the given tables (columns that are read), so no file is
# opened just to infer them.
GIVEN = {
    "customer": "c_custkey bigint, c_nationkey int, c_acctbal double, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_returnflag string",
    "supplier": "s_suppkey bigint",
}


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(GIVEN[table]).parquet(f"{sf_dir}/{table}.parquet")


def raw_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = given(spark, sf_dir, "customer")
    return spark.sql(RAW_STATIONS_SQL, customer=customer)


def raw_daily(spark: SparkSession, sf_dir: str, reporting: str = REPORTING_SQL) -> DataFrame:
    customer = given(spark, sf_dir, "customer")
    lineitem = given(spark, sf_dir, "lineitem")
    return spark.sql(
        RAW_DAILY_SQL.replace("{reporting}", reporting),
        customer=customer,
        lineitem=lineitem,
        raw_stations=raw_stations(spark, sf_dir),
    )


def oracle_ctes(daily_name: str = "raw_daily", reporting: str = REPORTING_SQL) -> str:
    """The two raw tables as CTE definitions for the checking engine."""
    daily = RAW_DAILY_SQL.replace("{reporting}", reporting)
    names = {"customer": "customer", "lineitem": "lineitem", "raw_stations": "raw_stations"}
    stations = RAW_STATIONS_SQL.format(**names)
    return f"raw_stations AS ({stations}), {daily_name} AS ({daily.format(**names)})"


def cells(raw_daily: DataFrame) -> DataFrame:
    """One row per (station, date, element): what a text file can hold.

    Flags are single characters; their largest code point is the largest flag,
    and aggregating numbers keeps the plan a hash aggregate.
    """
    flags = ("m_flag", "q_flag", "s_flag")
    largest = raw_daily.groupBy("station_id", "obs_date", "element").agg(
        F.max("data_value").alias("data_value"), *[F.max(F.ascii(c)).alias(c) for c in flags]
    )
    return largest.withColumns({c: F.char(c) for c in flags})


def daily_lines(raw_daily: DataFrame) -> DataFrame:
    """Fixed-width lines of a station, month and element from observations.

    At most 31 cells meet in a group, after duplicates are folded.
    """
    blank = F.lit(" ")
    flags = [F.coalesce(c, blank) for c in ("m_flag", "q_flag", "s_flag")]
    cell = F.concat(F.lpad(F.col("data_value").cast("string"), 5, " "), *flags)
    month = F.date_format("obs_date", "yyyyMM").alias("month")
    by_day = F.map_from_entries(F.collect_list(F.struct(F.dayofmonth("obs_date"), cell)))
    lines = cells(raw_daily).groupBy("station_id", month, "element").agg(by_day.alias("days"))
    body = F.transform(
        F.sequence(F.lit(1), F.lit(31)), lambda d: F.coalesce(F.col("days")[d], F.lit("-9999   "))
    )
    return lines.select(
        F.concat("station_id", "month", "element", F.array_join(body, "")).alias("value")
    )


def station_files(lines: DataFrame, folder: str) -> str:
    """The lines as one file per station, named after it."""
    spark = lines.sparkSession
    parted = f"{folder}-parts"
    named = lines.select(F.substring("value", 1, 11).alias("station"), "value").repartition("station")
    named.write.partitionBy("station").text(parted)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for status in files.globStatus(path(f"{parted}/station=*/part-*")):
        station = status.getPath().getParent().getName().split("=", 1)[1]
        files.rename(status.getPath(), path(f"{folder}/{station}.dly"))
    return folder


def old_lines(raw_stations: DataFrame) -> DataFrame:
    """A line of 1999 for some stations: their files hold nothing for the years that are asked for."""
    some = raw_stations.where(F.col("gsn_flag").isNotNull() & F.col("wmo_id").isNotNull())
    return some.select(F.concat("station_id", F.lit("199901TMAX   12   ")).alias("value"))


_STATION = "elevation, state, station_name, gsn_flag, hcn_flag, wmo_id"

#: Stations that also come with places that do not exist, and some of them twice.
ODD_STATIONS_SQL = f"""
SELECT station_id, latitude, longitude, {_STATION} FROM {{raw_stations}}
UNION ALL SELECT station_id, CAST(95 AS DOUBLE) AS latitude, longitude, {_STATION} FROM {{raw_stations}} WHERE wmo_id IS NOT NULL
UNION ALL SELECT station_id, latitude, CAST(-200 AS DOUBLE) AS longitude, {_STATION} FROM {{raw_stations}} WHERE gsn_flag IS NOT NULL
"""

#: Observations some of which also come without a station or without a day.
ODD_DAILY_SQL = """
SELECT station_id, obs_date, element, data_value, m_flag, q_flag, s_flag, obs_time FROM {raw_daily}
UNION ALL SELECT CAST(NULL AS STRING), obs_date, element, data_value, m_flag, q_flag, s_flag, obs_time FROM {raw_daily} WHERE m_flag = 'T'
UNION ALL SELECT station_id, CAST(NULL AS DATE), element, data_value, m_flag, q_flag, s_flag, obs_time FROM {raw_daily} WHERE q_flag = 'G'
"""

#: 200 invented two-letter codes with names; two in three have an ISO code.
COUNTRY_CODES_SQL = """
SELECT chr(65 + CAST(floor(k / 26) AS INT)) || chr(65 + CAST(k % 26 AS INT)) AS code,
  upper(segment) || ' ' || CAST(k AS STRING) AS name,
  CASE WHEN k % 3 <> 0 THEN chr(65 + CAST(floor(k / 26) AS INT)) || chr(65 + CAST(k % 26 AS INT)) || 'X' END AS iso3
FROM (SELECT c_custkey AS k, c_mktsegment AS segment FROM {customer} WHERE c_custkey < 200) t
"""

#: The stations with codes of that list; the thirty codes beyond it have no label.
FAR_STATIONS_SQL = """
SELECT chr(65 + CAST(floor(k / 26) AS INT)) || chr(65 + CAST(k % 26 AS INT)) || substr(station_id, 3, 9) AS station_id
FROM (SELECT station_id, CAST(substr(station_id, 3, 9) AS BIGINT) % 230 AS k FROM {raw_stations}) t
"""


def country_files(spark: SparkSession, sf_dir: str, folder: str) -> tuple[str, str]:
    """The fixed-width list of names and the CSV of ISO codes, as files."""
    countries = spark.sql(COUNTRY_CODES_SQL, customer=given(spark, sf_dir, "customer"))
    names, codes = f"{folder}/countries", f"{folder}/iso3"
    countries.select(F.concat("code", F.lit(" "), F.rpad("name", 61, " ")).alias("value")).write.text(names)
    countries.where(F.col("iso3").isNotNull()).select("code", "iso3").write.option("header", True).csv(codes)
    return names, codes


def damaged_lines(lines: DataFrame) -> DataFrame:
    """The same lines with unreadable years in March, months in May and first values in July."""
    value = F.col("value")
    month = value.substr(16, 2)

    def put(text: str, place: int):
        return F.overlay(value, F.lit(text), place)

    damaged = F.when(month == "03", put("x", 12)).when(month == "05", put("x", 16)).when(month == "07", put("  1x2", 22))
    return lines.select(damaged.otherwise(value).alias("value"))


def catalogue_lines(raw_stations: DataFrame) -> DataFrame:
    """Fixed-width catalogue lines; elevation is cut to whole metres."""

    def number(c: str, width: int, missing: str):
        text = F.format_string(f"%{width}.4f", F.col(c))
        return F.when(F.col(c).isNull(), F.lpad(F.lit(missing), width, " ")).otherwise(text)

    def text(c: str, width: int):
        return F.rpad(F.coalesce(F.col(c), F.lit("")), width, " ")

    meters = F.lpad(F.floor("elevation").cast("string"), 6, " ")
    gap = F.lit(" ")
    return raw_stations.select(
        F.concat(
            F.rpad("station_id", 11, " "), gap, number("latitude", 8, ""), gap,
            number("longitude", 9, ""), gap, F.coalesce(meters, F.lit("-999.9")), gap,
            text("state", 2), gap, text("station_name", 30), gap, text("gsn_flag", 3), gap,
            text("hcn_flag", 3), gap, text("wmo_id", 5),
        ).alias("value")
    )
