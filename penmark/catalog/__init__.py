"""Registered queries over the given tables, each with its reference SQL where SQL can say it."""

from penmark.catalog import (  # noqa: F401
    evaluation,
    features,
    models,
    profile,
    sampling,
    storage,
    streams,
    text,
    vectors,
)
from penmark.catalog.registry import ORACLES, QUERIES  # noqa: F401
