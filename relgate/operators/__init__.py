"""Gate operators; each takes and returns DataFrames."""
