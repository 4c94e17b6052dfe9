"""larkspur: columnar statistics, learning and search operators on Spark DataFrames."""
