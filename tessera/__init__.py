"""Spark-native evidence analytics: composable DataFrame operators, sources, plans and streams."""
