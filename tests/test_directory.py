"""Listings, search, selection and radius lookups."""

from __future__ import annotations

import math
import random

import pytest

from skyledger.operators import directory, radius
from skyledger.schemas import RAW_STATIONS
from skyledger.sources import read_country_dim, state_dim
from skyledger.sources.lookups import country_dim

COUNTRIES = [("US", "United States", "USA"), ("CA", "Canada", "CAN")]


def stations(spark, rows):
    """Rows are (id, name, lat, lon, state)."""
    full = [(s, lat, lon, None, state, name, None, None, None) for s, name, lat, lon, state in rows]
    return spark.createDataFrame(full, RAW_STATIONS)


@pytest.fixture
def some(spark):
    return stations(
        spark,
        [
            ("US000000001", "ALPHA", 1.0, 1.0, "WA"),
            ("US000000002", "BETA 100%", 1.1, 1.0, "XX"),
            ("US000000003", "ALPHA", 1.0, 1.0, "WA"),
            ("CA000000004", "ALPHABET", 50.0, 1.0, "WA"),
            ("CA000000005", "GAMMA", None, 1.0, None),
            ("QQ000000006", "DELTA", 2.0, 2.0, ""),
        ],
    )


@pytest.fixture
def states(spark):
    return state_dim(spark)


@pytest.fixture
def countries(spark):
    return country_dim(spark, COUNTRIES)


def pairs(df):
    return [tuple(r) for r in df.collect()]


def test_labels_fall_back_to_codes(some, states, countries):
    assert pairs(directory.states_available(some, states)) == [("WA", "Washington (WA)"), ("XX", "XX (XX)")]
    assert pairs(directory.countries_available(some, countries)) == [
        ("CA", "Canada (CAN)"),
        ("QQ", "QQ (QQ)"),
        ("US", "United States (USA)"),
    ]


def test_state_listing_ignores_country_but_names_do_not(some):
    ids = [r.station_id for r in directory.stations_for_location(some, state="WA").collect()]
    assert ids == ["CA000000004", "US000000001", "US000000003"]
    names = [r.station_id for r in directory.station_names(some, "US", "WA").collect()]
    assert names == ["US000000001", "US000000003"]


def test_places_are_distinct_and_located(some):
    assert pairs(directory.station_places(some, "US")) == [("ALPHA", 1.0, 1.0), ("BETA 100%", 1.1, 1.0)]
    assert pairs(directory.station_places(some, "CA")) == [("ALPHABET", 50.0, 1.0)]


def test_search(some, states, countries):
    def search(text, **where):
        return pairs(directory.search_stations(some, text, states, countries, **where))

    assert search("alph", country="CA") == [("ALPHABET", "ALPHABET, Washington, Canada", 50.0, 1.0)]
    assert search("PHA", state="WA") == [("ALPHA", "ALPHA, Washington, United States", 1.0, 1.0)]
    assert search("delta", country="QQ") == [("DELTA", "DELTA, QQ", 2.0, 2.0)]
    assert search("a_pha", country="US") == search("alpha", country="US")
    assert search("zzz", country="US") == []
    with pytest.raises(ValueError):
        search("alpha")


def test_search_limit(spark, states, countries):
    many = stations(spark, [(f"US{n:09d}", f"PLACE {n:03d}", float(n % 90), 1.0, "WA") for n in range(80)])
    found = pairs(directory.search_stations(many, "place", states, countries, country="US"))
    assert [r[0] for r in found] == [f"PLACE {n:03d}" for n in range(50)]


def test_coordinates(some):
    assert pairs(directory.station_coordinates(some, "US000000002")) == [(1.1, 1.0)]
    assert pairs(directory.station_coordinates(some, "nowhere")) == [(0.0, 0.0)]


def test_search_then_radius_and_its_fallback(some, states, countries):
    def around(text):
        return pairs(
            directory.search_then_radius(some, text, 50, states, countries, country="US").select(
                "station_id", "distance_km"
            )
        )

    assert around("beta") == [("US000000002", 0.0), ("US000000001", 11.1), ("US000000003", 11.1)]
    assert around("none") == [("US000000001", None), ("US000000002", None), ("US000000003", None)]


def test_resolution_order(some):
    def ids(**where):
        return [r.station_id for r in directory.resolve_stations(some, **where).collect()]

    assert ids(station_ids=["X", "Y"], state="WA") == ["X", "Y"]
    assert ids(state="XX", country="CA") == ["US000000002"]
    assert ids(country="QQ", point=(50.0, 1.0)) == ["QQ000000006"]
    assert ids(point=(50.0, 1.0)) == ["CA000000004"]
    with pytest.raises(ValueError):
        ids()


def available(spark, rows):
    return spark.createDataFrame(
        [(s, n, 1.0, 1.0, None, "Polar", t) for s, n, t in rows],
        "station_id string, station_name string, latitude double, longitude double, "
        "elevation double, climate_zone string, has_temp boolean",
    )


def test_default_selection_prefers_temperature(spark):
    def chosen(rows):
        return [r.station_id for r in directory.default_selection(available(spark, rows)).collect()]

    assert chosen([("a", "D", True), ("b", "A", False), ("c", "C", True), ("d", "B", False)]) == ["c", "a"]
    assert chosen([("a", "D", False), ("b", "A", False), ("c", "C", False), ("d", "B", False)]) == ["b", "d", "c"]
    assert chosen([]) == []


def test_sample_prefers_stations_with_temperature(spark):
    ids = [f"US1X{n:07d}" for n in range(20)] + [f"USW{n:08d}" for n in range(5)]
    df = spark.createDataFrame([(s,) for s in ids], "station_id string")
    sample = [r.station_id for r in directory.capped_sample(df, 8).collect()]
    assert sample == sorted(sample) and len(sample) == 8
    assert sum(s.startswith("USW") for s in sample) == 5
    again = [r.station_id for r in directory.capped_sample(df.repartition(7), 8).collect()]
    assert again == sample
    other = [r.station_id for r in directory.capped_sample(df, 8, seed=1).collect()]
    assert other != sample


def test_country_labels_from_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("US United States\nZZ Nowhere (Far)\n")
    (tmp_path / "iso.csv").write_text("code,iso3\nUS,USA\n")
    dim = read_country_dim(spark, str(tmp_path / "names.txt"), str(tmp_path / "iso.csv"))
    assert sorted(pairs(dim)) == [("US", "United States", "USA"), ("ZZ", "Nowhere (Far)", None)]
    bare = read_country_dim(spark, str(tmp_path / "names.txt"))
    assert sorted(pairs(bare)) == [("US", "United States", None), ("ZZ", "Nowhere (Far)", None)]


def great_circle(lat1, lon1, lat2, lon2):
    p, q = math.radians(lat1), math.radians(lat2)
    cosine = math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(math.radians(lon2 - lon1))
    return 6371.0 * math.acos(max(-1.0, min(1.0, cosine)))


@pytest.mark.parametrize("cell", [0.25, 1.0, 7.0])
def test_grid_search_matches_brute_force(spark, cell):
    rng = random.Random(5)
    placed = [
        (f"US{n:09d}", "N", rng.choice([rng.uniform(-90, 90), rng.uniform(10, 12)]), rng.uniform(-180, 180), None)
        for n in range(500)
    ] + [("US999999999", "N", None, 1.0, None), ("US999999998", "N", 92.0, -181.0, None)]
    points = [(n, rng.uniform(-85, 85), rng.uniform(-180, 180), rng.choice([10, 300, 900, 4000, 19000])) for n in range(60)]
    points.append((61, 90.0, -179.5, 900))
    points.append((60, None, 0.0, 10))
    points = [(n, lat, lon, float(r)) for n, lat, lon, r in points]
    expected = set()
    for pid, lat, lon, r in points:
        reach = r / 111 + 0.5
        for sid, _, slat, slon, _ in placed:
            if lat is None or slat is None or abs(slat - lat) > reach or abs(slon - lon) > reach:
                continue
            if great_circle(lat, lon, slat, slon) <= r:
                expected.add((pid, sid))
    df = spark.createDataFrame(points, "point_id int, latitude double, longitude double, radius_km double")
    got = radius.stations_near_points(stations(spark, placed), df, cell_degrees=cell).collect()
    assert len(got) == len(expected) > 10
    assert {(r.point_id, r.station_id) for r in got} == expected


def test_box_cuts_near_the_pole_unless_relaxed(spark):
    near_pole = stations(spark, [("NO000000001", "N", 89.9, 100.0, None), ("NO000000002", "N", 89.9, 0.9, None)])
    strict = radius.stations_near_point(near_pole, 89.9, 0.0, 50).collect()
    relaxed = radius.stations_near_point(near_pole, 89.9, 0.0, 50, strict_box=False).collect()
    assert [r.station_id for r in strict] == ["NO000000002"]
    assert {r.station_id for r in relaxed} == {"NO000000001", "NO000000002"}


def test_far_station_changes_nothing(spark):
    base = [("US000000001", "N", 10.0, 10.0, None), ("US000000002", "N", 10.2, 10.0, None)]
    one = radius.stations_near_point(stations(spark, base), 10, 10, 50).collect()
    two = radius.stations_near_point(
        stations(spark, [*base, ("US000000003", "N", -40.0, 99.0, None)]), 10, 10, 50
    ).collect()
    assert one == two
    assert [r.distance_km for r in one] == [0.0, 22.2]
