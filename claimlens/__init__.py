"""claimlens: claim-verification analytics on Spark DataFrames."""
