"""Options of an aggregation job, checked before the job starts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tickloom.sources.connections import read_config

# Legal window lengths in milliseconds
MIN_WINDOW_MS = 100
MAX_WINDOW_MS = 3_600_000


@dataclass(frozen=True)
class AggregationOptions:
    window_ms: int = 1000
    output_format: str = "influxdb_line"
    output_dir: str = "./output"
    filename_prefix: str = "marketdata"
    enabled: bool = True

    def __post_init__(self):
        if not self.enabled:
            return
        if not MIN_WINDOW_MS <= self.window_ms <= MAX_WINDOW_MS:
            raise ValueError(f"window_ms must be between {MIN_WINDOW_MS} and {MAX_WINDOW_MS}, not {self.window_ms}")
        if not self.output_dir:
            raise ValueError("output_dir must not be empty")
        if not self.filename_prefix:
            raise ValueError("filename_prefix must not be empty")

    @property
    def csv(self) -> bool:
        return self.output_format in ("csv", "CSV")


def read_options(spark: SparkSession, path: str) -> AggregationOptions:
    """The ``aggregation`` object of a configuration file; absent entries keep their defaults, absent object: disabled."""
    row = read_config(spark, path).select("aggregation.*").first()
    given = {k: v for k, v in row.asDict().items() if v is not None} if row else {}
    return AggregationOptions(**{"enabled": False, **given})
