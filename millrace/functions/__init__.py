"""Column to Column functions; nothing here starts a job."""
