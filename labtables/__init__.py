"""Lab tracking and plate-report tables, computed as Spark jobs and streams."""
