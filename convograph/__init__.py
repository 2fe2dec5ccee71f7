"""Spark-first engine for chat-log corpora: normalised messages, documents, links, graphs, chunks and retrieval."""
