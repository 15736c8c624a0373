"""Structured Streaming forms of the job-state, expiry, rate and upsert operators."""
