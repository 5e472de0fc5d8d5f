"""spendspark: payment-ledger analytics as Spark jobs."""

from .config import Tunables

__all__ = ["Tunables"]
