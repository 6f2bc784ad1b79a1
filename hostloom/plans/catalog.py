"""All registered queries."""

from hostloom.plans import (  # noqa: F401  (importing registers the queries)
    catalog_change,
    catalog_documents,
    catalog_extract,
    catalog_jobs,
    catalog_logs,
    catalog_pages,
    catalog_report,
    catalog_sites,
    catalog_storage,
)
from hostloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
