"""Registered queries and their SQL: same keys."""
from __future__ import annotations

from . import audits, descriptors, evaluation, features, feeds, linear, models, more, paths, production, relative, reports, resampled, sequences, stack

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (features, more, paths, resampled, relative, evaluation, audits, production, reports, linear, stack, sequences, models, feeds, descriptors):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
