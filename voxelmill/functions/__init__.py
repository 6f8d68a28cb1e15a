"""voxelmill.functions"""
