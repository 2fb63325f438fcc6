"""Flow graphs and their runs in bulk."""
