"""Plans: Cypher to DataFrames, and reports."""
