"""Sources and sinks: page tables, JSON lines, the stored index."""
