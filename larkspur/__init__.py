"""larkspur: everyday table, text and stream analytics as Spark DataFrame jobs."""
