"""Build and judge document re-ranking data with Spark DataFrames."""
