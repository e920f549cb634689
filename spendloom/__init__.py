"""Usage and cost analytics over coding-agent session logs, as Spark jobs."""
