"""Document, text-quality, retrieval and transcript analytics on Spark."""
