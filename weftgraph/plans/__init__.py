"""Plans: whole flows composed of operators, and the registered queries."""
