"""pipelens: software-pipeline analytics on PySpark DataFrames."""
