"""Operators for building training data from a corpus of documents and pages.

Nothing outside this subpackage imports it. Functions that run in Python workers are
pickled by value, so executors need not have the package on their path.
"""

from __future__ import annotations
