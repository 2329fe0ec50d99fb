"""Market-feed and tagged-metrics analytics on Spark DataFrames."""
