"""A Spark-native analytics engine: expression frames, datasets, tensors, statistics and signals on DataFrames."""
