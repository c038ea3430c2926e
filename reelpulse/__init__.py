"""reelpulse: viewer-engagement analytics for subscription video, as Spark DataFrame jobs."""

from .session import checkpoint_dir, get_spark
from .sources.bindings import Star, load_star

__all__ = ["get_spark", "checkpoint_dir", "Star", "load_star"]
