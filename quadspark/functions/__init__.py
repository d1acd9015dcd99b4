"""Term and filter expressions."""
