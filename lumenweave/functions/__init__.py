"""Functions of the segmentation engine."""
