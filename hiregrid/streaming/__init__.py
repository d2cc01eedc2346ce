"""Structured Streaming over source checks: windowed health, and latest state kept by micro-batches."""
