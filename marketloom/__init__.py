"""Financial time-series statistics and dataset preparation as Spark jobs."""
