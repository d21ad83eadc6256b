"""Spark-first operators for gridded, layered series and the tables around them."""
