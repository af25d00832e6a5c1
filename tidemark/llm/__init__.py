"""Operators for training-data pipelines.

Each module holds one operator.  They share nothing with the cleaning part of
the library but its general helpers, and nothing in the library imports them.
"""
