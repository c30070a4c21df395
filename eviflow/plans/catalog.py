"""All registered queries; importing a module registers its queries."""

from eviflow.plans import curate_queries, evidence_queries, guard_queries, name_queries, review_queries, stream_queries, text_queries  # noqa: F401
from eviflow.plans.registry import QUERIES, SQL  # noqa: F401
