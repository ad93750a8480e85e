"""palimpsest: a PySpark engine for recognised text and scanned-document data."""
