"""Quoting for generated SQL expressions."""

from __future__ import annotations


def quote(value: str) -> str:
    """A Spark SQL string literal for any text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def name(column: str) -> str:
    """A quoted column reference."""
    return "`" + column.replace("`", "``") + "`"
