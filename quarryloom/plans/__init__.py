"""Named queries: a Spark plan and, where SQL can express it, its oracle."""
