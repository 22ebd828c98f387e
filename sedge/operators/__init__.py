"""Query operators over frames of documents."""

from .pipeline import aggregate  # noqa: F401
