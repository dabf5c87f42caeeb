"""Operators for training-data pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds the
queries of :mod:`tessera.llm.queries` only where it can be imported.
"""
