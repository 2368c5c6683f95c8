"""Sources and sinks: NDJSON reader with nested flattening, stand-in tables
from the driver's Parquet files, head extracts and CSV output."""

from homerange.sources import schemas, standin
from homerange.sources.reviews import flatten, read_ndjson, read_reviews_dataset, sample_head, write_csv

__all__ = ["flatten", "read_ndjson", "read_reviews_dataset", "sample_head", "schemas", "standin", "write_csv"]
