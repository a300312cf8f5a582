"""Sources and sinks: search hits, fetched bodies, chunk index, run log."""
