"""A funnel-analytics engine on Spark DataFrames."""
