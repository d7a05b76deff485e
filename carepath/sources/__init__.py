"""Sources and sinks: driver tables mapped onto the clinical shapes, raw clinical CSV extracts with explicit
schemas, Parquet landing and artifacts."""
