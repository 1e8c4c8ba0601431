"""Jobs built from several operators, and the registry of queries."""
