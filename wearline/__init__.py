"""wearline: condition monitoring and reliability analytics as plain Spark jobs."""
