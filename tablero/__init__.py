"""Sales analytics on Spark: typed star schema, generation, integrity jobs and dashboards."""
