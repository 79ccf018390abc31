"""Lodestone: grounded retrieval over text corpora as PySpark DataFrame and SQL operations."""
