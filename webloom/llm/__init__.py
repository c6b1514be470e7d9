"""Training-data pipeline operators.  Nothing else in the library imports this
subpackage; ``queries.QUERIES`` and ``queries.ORACLE_SQL`` hold its queries."""
