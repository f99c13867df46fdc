"""zonemill: small-area raster, polygon and table analytics as Spark DataFrame operators."""

from zonemill.model import Grid
from zonemill.session import checkpointed, get_session

__all__ = ["Grid", "checkpointed", "get_session"]
