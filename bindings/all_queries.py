"""Imports every query module, which registers its queries."""

from bindings import climate, evaluation, events, features, models, quality, sources, stats, windows  # noqa: F401
