"""End-to-end jobs, and the queries that the driver checks."""
