"""Reading candidate data and publishing released data."""
