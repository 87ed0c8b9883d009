"""Spark-native quantification of records that map ambiguously to several features."""
