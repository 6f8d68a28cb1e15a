"""voxelmill.streaming"""
