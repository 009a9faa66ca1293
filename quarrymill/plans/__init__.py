"""Named queries over the Parquet tables, each beside the SQL it must equal."""
