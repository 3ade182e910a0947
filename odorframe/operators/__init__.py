"""Importing any operator makes all generators available by name."""

from odorframe.operators import mixture, oversample  # noqa: F401
