"""All registered queries of the engine, and their SQL."""

from __future__ import annotations

from contactgrid.plans import registry, registry_files, registry_lists, registry_loops, registry_maps

FLAGSHIP, ORACLES, QUERIES = registry.FLAGSHIP, registry.ORACLES, registry.QUERIES
#: The modules whose import registers queries.
MODULES = (registry, registry_files, registry_lists, registry_loops, registry_maps)
