"""Sources and sinks: delimited files, records, caches, as-of views."""
