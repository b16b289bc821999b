"""Training-data operators: dedup, quality, extraction, packing and scanning.

The subpackage stands alone: nothing else in the library imports it, and it
imports nothing of the library.
"""
