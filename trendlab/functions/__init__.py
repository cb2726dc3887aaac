"""Column-level building blocks (no DataFrames in here)."""
