"""Imports every query module so that the registry is complete."""

from voxelmill.plans import q_boxes, q_index, q_io, q_joins, q_metrics, q_points, q_quality, q_raster, q_sampling, q_steps, q_suppress, q_voxels  # noqa: F401
from voxelmill.plans.registry import ORACLES, QUERIES  # noqa: F401
