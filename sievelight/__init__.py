"""Spark-native secret and exposure analytics: detectors are DataFrame-to-DataFrame functions."""
