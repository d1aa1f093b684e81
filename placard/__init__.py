"""Spark jobs for following a changing catalogue of places, scheduled shows and press."""
