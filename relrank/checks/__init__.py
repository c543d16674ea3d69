"""Every operator as a query over the sample tables, with its SQL twin."""

from relrank.checks.registry import ORACLE, QUERIES
from relrank.checks import candidates, files, metrics, sampling, scoring, text  # noqa: F401  (they register)

__all__ = ["ORACLE", "QUERIES"]
