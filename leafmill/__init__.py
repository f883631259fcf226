"""leafmill: document analytics as Spark jobs."""
