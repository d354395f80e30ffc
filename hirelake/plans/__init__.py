"""Query plans: the derived tables and the registered queries with their SQL."""
