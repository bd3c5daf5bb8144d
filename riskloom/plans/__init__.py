"""The query catalogue."""

from . import calibration, cards, curation, decisions, evaluation, governance, links, models, queues, sampling, star, streams
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "calibration", "cards", "curation", "decisions", "evaluation", "governance", "links", "models", "queues", "sampling", "star", "streams"]
