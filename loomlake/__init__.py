"""Document retrieval on Spark: chunks, indexes, rankings, sessions and question answering."""
