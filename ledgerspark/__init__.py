"""Financial-table extraction, retrieval and analytics on PySpark."""
