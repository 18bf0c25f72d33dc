"""tracelab: Spark jobs that evaluate reasoning traces at scale."""
