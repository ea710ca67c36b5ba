"""Configurations, the selection pipeline and the experiment drivers."""

from .config import Config, ablations, paper_default, soft, strict
from .selector import Selector

__all__ = ["Config", "Selector", "ablations", "paper_default", "soft", "strict"]
