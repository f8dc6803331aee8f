"""Files, message queues and models: reading and writing."""
