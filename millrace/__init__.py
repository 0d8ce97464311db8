"""Data operations on Spark: queries, tables, models, catalogue, run history and message streams."""
