"""Point-in-time event analytics, declared as Spark plans."""
