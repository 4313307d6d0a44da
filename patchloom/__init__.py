"""Change-review analytics on Spark: DataFrame operators, sources and query plans."""
