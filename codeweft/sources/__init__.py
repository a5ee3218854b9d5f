"""Sources: source trees, change feeds."""
