"""Small SQL text helpers for the checking engine."""

from __future__ import annotations


def rnd(expr: str, digits: int) -> str:
    """Correctly rounded decimal (half to even on the exact value), via C-style formatting."""
    return f"CAST(printf('%.{digits}f', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def div(num: str, den: str) -> str:
    return f"(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0))"
