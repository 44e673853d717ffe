"""Stations within a radius: of one point, or of many points at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import half_even, haversine_km

# The search box reaches radius/111 + 0.5 degrees each way.
KM_PER_DEGREE, MARGIN_DEGREES = 111.0, 0.5


def _margin(radius_km: Column) -> Column:
    return radius_km / KM_PER_DEGREE + MARGIN_DEGREES


def stations_near(
    stations: DataFrame, lat: Column, lon: Column, radius_km: Column, *, strict_box: bool = True
) -> DataFrame:
    """Stations within ``radius_km`` of one point given as expressions.

    The box is a pair of plain range predicates, so literals reach the Parquet
    scan. It uses the same margin for longitude and does not wrap at 180
    degrees; ``strict_box=False`` bounds latitude alone, which loses no station
    near the poles or the date line.
    """
    margin = _margin(radius_km)
    box = F.col("latitude").between(lat - margin, lat + margin)
    if strict_box:
        box = box & F.col("longitude").between(lon - margin, lon + margin)
    distance = haversine_km(lat, lon, F.col("latitude"), F.col("longitude"))
    return (
        stations.where(box)
        .withColumn("km", distance)
        .where(F.col("km") <= radius_km)
        .select(
            "station_id",
            "station_name",
            "latitude",
            "longitude",
            half_even(F.col("km"), 1).alias("distance_km"),
        )
    )


def stations_near_point(
    stations: DataFrame, lat: float, lon: float, radius_km: float, *, strict_box: bool = True
) -> DataFrame:
    near = stations_near(
        stations,
        F.lit(float(lat)),
        F.lit(float(lon)),
        F.lit(float(radius_km)),
        strict_box=strict_box,
    )
    return near.orderBy("distance_km", "station_id")


#: A box reaches at most this many cells from its centre in each direction.
REACH_CELLS = 4


def _level(margin: Column, cell_degrees: float) -> Column:
    """How often the base cell is doubled so that a box spans a bounded number of cells."""
    doublings = F.ceil(F.log2(F.least(margin, F.lit(180.0)) / (cell_degrees * REACH_CELLS)))
    return F.greatest(doublings, F.lit(0)).cast("int")


def _cell(degrees: Column, limit: float, cell_degrees: float) -> Column:
    """Cell of a coordinate; values off the map belong to the cell at its edge."""
    on_map = F.least(F.greatest(degrees, F.lit(-limit)), F.lit(limit))
    size = F.pow(F.lit(2.0), F.col("level")) * cell_degrees
    return F.floor(on_map / size).cast("int")


def _relaxed_margin(lat: Column, margin: Column) -> Column:
    """Degrees of longitude that ``margin`` degrees of the globe reach at this latitude."""
    edge = F.abs(lat) + margin
    return F.when(edge >= 89.0, F.lit(180.0)).otherwise(F.least(margin / F.cos(F.radians(edge)), F.lit(180.0)))


def _cells_around(center: Column, margin: Column, cell_degrees: float) -> Column:
    """Cells of longitude within ``margin`` of ``center``, also across 180 degrees."""

    def part(shift: float) -> Column:
        low = F.greatest(center + shift - margin, F.lit(-180.0))
        high = F.least(center + shift + margin, F.lit(180.0))
        cells = F.sequence(_cell(low, 180.0, cell_degrees), _cell(high, 180.0, cell_degrees))
        return F.when(low <= high, cells).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.concat(part(0.0), part(-360.0), part(360.0)))


def _cells_across(center: Column, margin: Column, limit: float, cell_degrees: float) -> Column:
    return F.sequence(
        _cell(center - margin, limit, cell_degrees), _cell(center + margin, limit, cell_degrees)
    )


def stations_near_points(
    stations: DataFrame, points: DataFrame, *, cell_degrees: float = 1.0, strict_box: bool = True
) -> DataFrame:
    """Every (point, station) pair within the point's own radius.

    ``points`` has point_id, latitude, longitude and radius_km. Stations get the
    grid cell they lie in, points all cells their box touches, and the two meet
    in an equi-join on the cell. A point with a wide box uses coarser cells, so
    it never touches more than about a hundred; stations are repeated only for
    the levels in use. Each pair is formed at most once, pairs without a shared
    cell never, and AQE can split a crowded cell. ``strict_box=False`` widens the
    box by latitude and lets it cross 180 degrees, so that distance alone decides.
    """
    lat, lon, radius = F.col("p_lat"), F.col("p_lon"), F.col("radius_km")
    margin = _margin(radius)
    leveled = points.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).select(
        "point_id",
        F.col("latitude").alias("p_lat"),
        F.col("longitude").alias("p_lon"),
        "radius_km",
        _level(
            _margin(F.col("radius_km"))
            if strict_box
            else _relaxed_margin(F.col("latitude"), _margin(F.col("radius_km"))),
            cell_degrees,
        ).alias("level"),
    )
    across = (
        _cells_across(lon, margin, 180.0, cell_degrees)
        if strict_box
        else _cells_around(lon, _relaxed_margin(lat, margin), cell_degrees)
    )
    boxes = leveled.withColumn(
        "cell_lat", F.explode(_cells_across(lat, margin, 90.0, cell_degrees))
    ).withColumn("cell_lon", F.explode(across))
    levels = leveled.agg(F.collect_set("level")).scalar()
    placed = (
        stations.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select("station_id", "latitude", "longitude")
        .withColumn("level", F.explode(levels))
        .withColumn("cell_lat", _cell(F.col("latitude"), 90.0, cell_degrees))
        .withColumn("cell_lon", _cell(F.col("longitude"), 180.0, cell_degrees))
    )
    pairs = placed.join(boxes, ["level", "cell_lat", "cell_lon"], "inner")
    if strict_box:
        pairs = pairs.where(
            F.col("latitude").between(lat - margin, lat + margin)
            & F.col("longitude").between(lon - margin, lon + margin)
        )
    distance = haversine_km(lat, lon, F.col("latitude"), F.col("longitude"))
    return (
        pairs.withColumn("km", distance)
        .where(F.col("km") <= radius)
        .select("point_id", "station_id", half_even(F.col("km"), 1).alias("distance_km"))
    )
