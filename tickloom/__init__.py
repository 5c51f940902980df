"""tickloom: DataFrame operators for high-frequency event data on Spark."""

__version__ = "0.1.0"
