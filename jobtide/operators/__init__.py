"""Set-based operators over job tables: each takes and returns DataFrames."""
