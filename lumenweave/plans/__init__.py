"""Plans of the segmentation engine."""
