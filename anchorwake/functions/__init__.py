"""Column-level functions: zones, leverage and missing-value rules."""
