"""Property-listing analytics as composable Spark DataFrame and SQL transformations."""
