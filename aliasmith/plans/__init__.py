"""Whole jobs: preparing data, training, matching."""
