"""Registered queries by subject, each beside its DuckDB SQL."""
