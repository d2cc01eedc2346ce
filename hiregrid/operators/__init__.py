"""Relational operators over jobs, entities and source checks. Each takes DataFrames (and an explicit `as_of`) and returns DataFrames."""
