"""Operators for preparing training data at corpus scale.

Ten operators, one module each, plus the thin contract queries in
:mod:`tidemark.llm.queries`.  Nothing else in the library imports this subpackage.
"""
