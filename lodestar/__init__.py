"""Spark-native batch analytics engine: composable DataFrame operators and named queries."""
