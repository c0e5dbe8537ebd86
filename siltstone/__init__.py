"""Siltstone: recommender analytics and corpus preparation as Spark plans."""
