"""The registered queries: inputs derived from the driver's tables, Spark jobs, oracle SQL."""
