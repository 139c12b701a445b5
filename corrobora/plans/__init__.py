"""Queries over the driver's tables: name -> (function, oracle SQL or None)."""

from corrobora.plans import evaluation, evidence, publication

QUERIES = {**evaluation.QUERIES, **evidence.QUERIES, **publication.QUERIES}
