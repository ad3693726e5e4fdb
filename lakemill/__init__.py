"""lakemill: Pandas-like analytics in which every operation is a Spark plan."""
