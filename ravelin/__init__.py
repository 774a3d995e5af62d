"""Federated document retrieval and corpus operators as Spark plans."""
