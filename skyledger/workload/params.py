"""Parameters that the registered queries and their checking SQL share."""

from __future__ import annotations

import datetime

AS_OF = datetime.date(2024, 12, 25)
YEARS = (2023, 2024)

#: Labels for the country codes that occur in the derived stations. A user
#: supplies the whole list as a file, see ``sources.lookups.read_country_dim``.
COUNTRIES = [
    ("AS", "Australia", "AUS"),
    ("BR", "Brazil", "BRA"),
    ("CA", "Canada", "CAN"),
    ("GM", "Germany", "DEU"),
    ("NO", "Norway", "NOR"),
    ("RS", "Russia", "RUS"),
    ("US", "United States", "USA"),
]

STATE, COUNTRY = "WA", "CA"
SEARCH_TEXT = "build"
NO_SUCH_NAME = "no such place"
POINT = (10.0, 20.0)
RADIUS_KM = 1500.0
SAMPLE_SIZE, SAMPLE_SEED = 50, 42

#: Query points for the many-point radius search, one per supplier.
POINTS_SQL = """
SELECT CAST(s_suppkey AS INT) AS point_id,
  CAST((s_suppkey*6151) % 16001 AS DOUBLE)/100 - 80 AS latitude,
  CAST((s_suppkey*9973) % 36001 AS DOUBLE)/100 - 180 AS longitude,
  CAST(100 + (s_suppkey*37) % 10 * 100 AS DOUBLE) AS radius_km
FROM {supplier}
"""
