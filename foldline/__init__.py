"""foldline: leakage-safe rolling-origin evaluation and corpus operators on Spark DataFrames."""
