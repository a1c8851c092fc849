"""Column-expression builders (scalar functions of the pipeline)."""

from .emission import is_slow, is_tanker, mean_speed, move_emission, stop_emission
from .geo import (EDGE, EDGES, box_edges, central_angle, haversine_nm, point_in_edges_sql,
                  ring_edges)

__all__ = [
    "EDGE", "EDGES", "box_edges", "central_angle", "haversine_nm", "point_in_edges_sql",
    "ring_edges", "is_slow", "is_tanker", "mean_speed", "move_emission", "stop_emission",
]
