"""Directional change conventions mined from many version-control histories, as Spark jobs."""
