"""quillon: text retrieval and versioned-log analytics as PySpark plans."""
