"""lamella: voxel volumes, plane geometry and corpus preparation as PySpark DataFrames."""
