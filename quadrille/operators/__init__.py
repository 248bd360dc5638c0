"""Queries over points, updates, and the kernels of building and splitting trees of boxes."""
