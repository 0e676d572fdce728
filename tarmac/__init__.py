"""tarmac: event-time flight analytics as Spark DataFrame functions."""
