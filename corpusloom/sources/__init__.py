"""Sources and sinks: files, tables, logs and indexes."""
