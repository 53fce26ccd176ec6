"""Sources of the segmentation engine."""
