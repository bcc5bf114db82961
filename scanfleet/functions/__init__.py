"""Column functions: geometry, spatial keys, robust kernels."""
