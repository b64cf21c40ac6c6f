"""Spark-native redaction engine: rules, structural keys, files, events, images."""
