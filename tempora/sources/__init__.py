"""Scans, sinks and the frames derived from the driver tables."""

from tempora.sources.readers import (  # noqa: F401
    read_series, read_csv, read_parquet, read_feather, parse_timestamps,
    dedupe_first, generate_index, detect_datetime_column,
)
from tempora.sources.tables import (  # noqa: F401
    table, hourly_frame, daily_frame, EVENT_TYPES,
)
