"""Sequence-window analytics on Spark: counting, profiles and set algebra over k-letter words."""
