"""Spark-native analytics over corpora of verse and the data that surrounds them."""
