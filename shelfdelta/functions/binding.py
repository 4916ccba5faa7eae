"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once per row.

    Catalyst would otherwise repeat ``value`` wherever ``body`` mentions it, and once
    per element where that is inside a higher-order function.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
