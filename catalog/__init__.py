"""Query catalog used by ``__spark_entry__``: Spark queries next to their SQL checks."""
