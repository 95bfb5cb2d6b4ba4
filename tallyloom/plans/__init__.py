"""Composite operators: whole pipelines assembled from operators, functions and sources."""
