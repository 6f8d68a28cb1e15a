"""voxelmill.plans"""
