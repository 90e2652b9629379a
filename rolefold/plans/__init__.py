"""The queries over the driver tables, each with SQL for the same rows."""
