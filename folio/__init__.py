"""folio: document analytics on PySpark (ingestion, retrieval, graphs, evaluation)."""
