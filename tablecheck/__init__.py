"""tablecheck: data checks as Spark DataFrame plans."""

from .spec import Check, DatasetMeta, Filter, ForeignKey, Suite, Tolerance, Window

__all__ = ["Check", "DatasetMeta", "Filter", "ForeignKey", "Suite", "Tolerance", "Window"]
