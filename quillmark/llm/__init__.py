"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage; general helpers
(:mod:`quillmark.session`, :mod:`quillmark.operators.joins`) are imported
from here.
"""
