"""Sources and the sink for block-structured map extracts."""
