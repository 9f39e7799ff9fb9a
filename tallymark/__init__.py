"""Spark-native evaluation analytics: flags, thresholds, rankings, audits and text metrics as DataFrame plans."""
