"""All registered queries of the subpackage."""

from . import (  # noqa: F401
    chat,
    collocations,
    fingerprints,
    html,
    language,
    mixing,
    neardup,
    neighbours,
    packing,
    quality,
    sharding,
    substrings,
    tries,
)
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
