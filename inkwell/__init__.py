"""Stylometry and controlled rewriting as Spark plans."""
