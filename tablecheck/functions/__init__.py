"""Column expressions. Nothing here reads data or starts a job."""
