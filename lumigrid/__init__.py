"""Spark-native RGB-D scene analytics: every pixel is a row, every algorithm a plan."""
