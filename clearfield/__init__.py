"""Spatial analytics over point-cloud frames, expressed as Spark DataFrame plans."""
