"""Training-data operators: language ID, deduplication, decontamination, mixing and the like.

Self-contained: nothing outside this subpackage imports it.
"""
