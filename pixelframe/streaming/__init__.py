"""Transforms of images as they arrive."""
