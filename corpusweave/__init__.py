"""Parallel-corpus curation as Spark DataFrame operators."""

from corpusweave.plans.shipping import ship_package

__all__ = ["ship_package"]
