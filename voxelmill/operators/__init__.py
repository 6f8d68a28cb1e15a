"""voxelmill.operators"""
