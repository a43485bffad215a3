"""Operators for preparing training corpora.

Nothing outside this subpackage imports it.  Each operator has a general
function over any DataFrame; `queries` binds them to the project's tables.
"""
