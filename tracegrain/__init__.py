"""Spark-native log forensics."""
