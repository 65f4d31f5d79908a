"""tidemark: relational records and event logs to training-ready tables, on Spark."""
