"""Spark jobs that turn a corpus of recorded talks into transcripts, timelines and summaries."""
