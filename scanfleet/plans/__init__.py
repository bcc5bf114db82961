"""Iterative jobs: registration, pose graph, bundle adjustment, map building."""
