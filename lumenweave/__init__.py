"""Soft segmentation of images as Spark queries: mattes, colours and the graphs behind them."""
