"""All queries of the engine's own operators."""

from . import control_queries, dataset_queries, function_queries, kernel_queries, patch_queries, project_queries, series_queries, sounding_queries, stage_queries, surface_queries

MODULES = (control_queries, dataset_queries, function_queries, kernel_queries, patch_queries, project_queries, series_queries, sounding_queries, stage_queries, surface_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
