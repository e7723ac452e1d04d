"""All queries of the library's own operators, and DuckDB SQL for the same rows."""

from __future__ import annotations

from sluice.plans import arrays, checks, extended, external, fields, files, identity, joins, latents, manifest, ordered, positions, profile, records, sampling, sequences, states, streams, temporal, text
from sluice.plans.catalog import ORACLE_SQL, QUERIES

MODULES = (arrays, checks, extended, external, fields, files, identity, joins, latents, manifest, ordered, positions, profile, records, sampling, sequences, states, streams, temporal, text)

__all__ = ["MODULES", "ORACLE_SQL", "QUERIES"]
