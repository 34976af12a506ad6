"""Scaffold and decoration data jobs for molecule tables, as Spark DataFrame operators."""
