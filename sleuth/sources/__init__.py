"""Sources and sinks: driver tables, log readers, writers."""
