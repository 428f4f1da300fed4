"""DataFrame operators: joins, aggregates, islands, series, quality, sets, statistics, near-duplicates."""
