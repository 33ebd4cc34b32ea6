"""Operators for large-scale training-data pipelines (see README, section "llm").

Nothing else in the library imports this subpackage.
"""
