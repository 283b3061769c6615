"""Two-dimensional spatial analytics on Spark: search, nearest neighbours, joins and clustering."""

from tessera.errors import SpatialError
from tessera.sources.frame import SpatialFrame, boxes, points

__all__ = ["SpatialError", "SpatialFrame", "boxes", "points"]
__version__ = "0.1.0"
