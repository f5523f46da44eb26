"""All registered queries, one module per operator family."""

from textlake.plans.base import ORACLES, QUERIES
from textlake.plans import txt, src, pro, gen, sem, det, val, rel, eva

__all__ = ["ORACLES", "QUERIES"]
