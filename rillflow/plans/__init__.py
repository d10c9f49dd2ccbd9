"""Whole jobs: a source, a decode, a transform and a sink."""
