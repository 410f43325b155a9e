"""Files, notes and patches as DataFrames."""
