"""Spark-first analytics and hybrid-retrieval engine over curated place, review and document tables."""
