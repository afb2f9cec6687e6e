"""Incremental analytics on Spark: keyed sources, relational operators, reconciliation, ledgers and streams."""
