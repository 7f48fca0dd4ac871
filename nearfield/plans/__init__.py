"""Query building, strategy routing and settings."""

from .builder import Knn, knn
from .router import Feedback, Router
from .settings import Settings

__all__ = ["Feedback", "Knn", "Router", "Settings", "knn"]
