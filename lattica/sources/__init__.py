"""Sources and sinks: volumes as Parquet, struct-packed files, metadata and report texts, image stacks."""
