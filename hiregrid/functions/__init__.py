"""Scalar recipes: plain Python functions from Column to Column, all built from JVM-side expressions."""
