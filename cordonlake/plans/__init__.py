"""Whole chains of operators: from fetched documents to a table of chunks, from questions to answers that stand."""
