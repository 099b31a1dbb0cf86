"""Lectern: document retrieval and text-reuse analytics as Spark plans."""
