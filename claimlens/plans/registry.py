"""Every query of the engine by its key, and its SQL."""

from __future__ import annotations

from claimlens.streaming import audit as stream
from claimlens.streaming import changes

from . import admin, audit, calibration, crossfile, details, documents, dtos, entities, files, findings, meta_model, metadata, rules, texts

MODULES = [audit, admin, rules, calibration, meta_model, crossfile, texts, documents, entities, dtos, metadata, findings, files, details, stream, changes]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
