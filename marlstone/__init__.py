"""Marlstone: PySpark transforms for coverage, ledger, rule and log analytics."""
