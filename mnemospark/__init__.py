"""Memory retrieval and session analytics on PySpark."""
