"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  The registered
queries (``op1_*`` .. ``op13_*`` and ``pipeline``) are wired in ``catalog``.
"""
