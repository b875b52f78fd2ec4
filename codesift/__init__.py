"""Source scanning and corpus analytics as Spark jobs."""
