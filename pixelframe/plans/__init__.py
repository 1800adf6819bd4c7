"""Whole jobs: class_distribution(), augment(), transform()."""
