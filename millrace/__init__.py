"""millrace: inventory, duplicate and text-corpus analytics written for Spark's DataFrame API."""
