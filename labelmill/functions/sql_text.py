"""Spark SQL text for wide generated expressions: one parsed string instead of a call per operator."""

from __future__ import annotations


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def value(literal) -> str:
    if literal is None:
        return "NULL"
    if isinstance(literal, bool):
        return "true" if literal else "false"
    if isinstance(literal, int):
        return str(literal)
    if isinstance(literal, float):
        return f"double('{literal!r}')"
    return "'" + str(literal).replace("\\", "\\\\").replace("'", "\\'") + "'"


def values(literals) -> str:
    return ", ".join(value(literal) for literal in literals)
