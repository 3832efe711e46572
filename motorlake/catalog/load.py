"""Importing this module registers every query."""

from motorlake.catalog import (  # noqa: F401
    cleaning,
    warehouse,
    marts,
    features,
    scoring,
    actions,
    reports,
    streams,
    storage,
)
