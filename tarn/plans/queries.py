"""All queries of the panel operators."""

from . import aggregates, models, scalars, windowed  # noqa: F401  they register their queries
from .base import QUERIES, SQL  # noqa: F401
