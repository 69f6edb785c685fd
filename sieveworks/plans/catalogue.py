"""Queries of the core operators and their SQL twins."""

from __future__ import annotations

from sieveworks.plans import curation, evaluation, files, rasters, small_files

MODULES = [files, curation, evaluation, rasters, small_files]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
