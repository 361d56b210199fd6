"""Reading and writing tables, metadata, payload batches, staging data and run logs."""
