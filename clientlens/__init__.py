"""Customer features on Spark: reusable DataFrame operators and feature plans."""
