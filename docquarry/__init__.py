"""Document analytics on Spark: cleaning, sectioning, matching, citations, retrieval."""
