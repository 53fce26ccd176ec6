"""Operators of the segmentation engine."""
