"""Column-level building blocks (no job is run here)."""
