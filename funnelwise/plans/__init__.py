"""The registered statements (Spark) and their DuckDB oracle texts."""
