"""Incremental jobs on Structured Streaming (the reference has no streams;
its resumable caption enrichment is the one incremental workload)."""
