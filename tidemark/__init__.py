"""tidemark: dataset-audit, detection-stream and training-data analytics on Spark DataFrames."""
