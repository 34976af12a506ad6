"""Registered queries over the given tables, each with its oracle where SQL can say it."""

from . import files, model, molecules, statistics, text, vocabulary  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
