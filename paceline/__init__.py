"""Team movement analytics over tracked-person tables, as Spark jobs."""
