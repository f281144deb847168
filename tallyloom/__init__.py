"""Tallyloom: transcript retrieval, session analytics and corpus preparation on Spark."""
