"""Composite queries; importing this registers them."""

from . import detections, exchange, levels, overlays, realterrain, sitework, sweeps, terrainwork, tilework  # noqa: F401
