"""Spark-native analytics over corpora of manuscripts."""
