"""Reading and writing Parquet, and Arrow ingestion."""
