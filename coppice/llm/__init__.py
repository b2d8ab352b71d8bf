"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage; it depends only on the shared
session and component helpers of the library itself.
"""
