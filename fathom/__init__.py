"""fathom: a Spark-first engine for document retrieval and analytics."""
