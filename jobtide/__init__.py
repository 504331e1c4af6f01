"""Job and task queues as data: set-based operators on Spark DataFrames and streams."""
