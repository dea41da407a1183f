"""tessera: search, vector analytics and text processing as Spark DataFrame functions."""
