"""Lodestone: knowledge-graph retrieval and ranking expressed as Spark plans."""
