"""tidelog: partitioned event logs and their analytics on Spark."""
