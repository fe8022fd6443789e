"""Registered queries: operators bound to the test tables, with DuckDB SQL beside them."""
