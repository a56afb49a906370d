"""Sources and sinks: driver tables, derived fixtures, forecast files."""
