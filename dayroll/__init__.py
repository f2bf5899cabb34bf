"""Spark-native analytics for personal telemetry: daily roll-ups, keyed state, reports and a small registry."""
