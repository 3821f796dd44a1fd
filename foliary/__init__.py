"""foliary: document-archive analytics as lazy PySpark plans."""
