"""Evidence-backed entity search and text analytics as Spark DataFrame jobs."""
