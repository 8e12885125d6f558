"""All registered queries of the log operators: importing a module registers its queries."""

from logfacts.plans import checked, ingest, lists, more, queries, states  # noqa: F401
from logfacts.plans.queries import ORACLES, QUERIES  # noqa: F401
