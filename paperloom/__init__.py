"""Spark-first engine for document analytics and the business records found in documents."""
