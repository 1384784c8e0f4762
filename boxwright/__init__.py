"""Exact range, nearest-neighbour and intersection queries over boxes, on Spark."""
