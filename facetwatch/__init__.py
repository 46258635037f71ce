"""Spark jobs that watch the health of many-part optical surfaces from images."""
