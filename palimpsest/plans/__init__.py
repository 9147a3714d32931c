"""Queries by topic; importing this package registers all of them."""

from . import changes, enriched, hierarchy, linked, listed, nesting, operational, pagestate, revisions, texts, wikitext  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
