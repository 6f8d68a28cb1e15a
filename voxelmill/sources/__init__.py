"""voxelmill.sources"""
