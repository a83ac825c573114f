"""Corpora of pages and texts to deduplicated, scored, size-bounded chunks, on Spark."""
