"""Collects the catalog modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("detectors", "narrations", "text", "cases", "velocity", "entities", "graph", "scores", "traversal", "signals", "responses", "canvas", "tables", "ingest", "entity_links", "extractions")


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"catalog.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"query names defined twice: {sorted(clash)}")
        merged.update(part)
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
