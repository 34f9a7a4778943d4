"""Knowledge-graph analytics over append-only conversation logs, as Spark plans."""
