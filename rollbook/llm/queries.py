"""Queries of the problems, registered by name."""

from __future__ import annotations

from rollbook.plans.registry import Registry

REG = Registry()

from rollbook.llm import queries_canonical, queries_pairs, queries_persons, queries_reading, queries_resolution, queries_size  # noqa: E402,F401
