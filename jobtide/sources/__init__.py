"""Reading and writing journals, logs and job tables."""
