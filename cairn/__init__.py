"""Spark-native analytics for georeferenced 3-D survey data."""
