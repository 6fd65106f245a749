"""biorec: biological-recording data as Spark DataFrames."""
