"""Operators on crops, volumes, planes, meshes and nuclei; each maps DataFrames to a DataFrame."""
