"""Captured payloads into one schema of jobs: readers and normalisers, all declarative."""
