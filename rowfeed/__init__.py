"""rowfeed: reading, filtering, sampling and reshaping Parquet datasets with Spark, for analytics and model training."""

from rowfeed.schema import Field, Schema
from rowfeed.sources.scan import Scan, read_batches, read_rows

__all__ = ["Field", "Scan", "Schema", "read_batches", "read_rows"]
__version__ = "0.1.0"
