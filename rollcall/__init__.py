"""A Spark-native engine that resolves, merges and scores person records from inconsistent sources."""
