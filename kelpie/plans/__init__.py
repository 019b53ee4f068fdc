"""Registered queries: operators bound to the tables, each with its DuckDB SQL where SQL can express it."""
