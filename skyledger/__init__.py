"""Daily weather-station analytics written as Spark DataFrame plans."""

__version__ = "0.1.0"
