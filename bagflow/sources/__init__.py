"""Sources: the caller's own partitions, parquet tables, and an archive of hourly event files."""

from bagflow.sources.archive import EVENT_SCHEMA, commits, events
from bagflow.sources.external import Partition, external, table

__all__ = ["EVENT_SCHEMA", "Partition", "commits", "events", "external", "table"]
