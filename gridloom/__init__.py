"""Spatial graphs and text corpora on Spark."""
