"""Haberdash: retail analytics as PySpark DataFrame plans.

Seven raw relations flow through four layers: ``src`` (stored as imported),
``cleaned`` (lazy), ``analytics`` (a stored star schema) and ``reporting``
(lazy). Analyses and checks are functions from DataFrames to a DataFrame.
"""

from haberdash.sources.warehouse import Warehouse

__all__ = ["Warehouse"]
