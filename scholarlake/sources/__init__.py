"""Sources and sinks: files, layout blocks, outside services."""
