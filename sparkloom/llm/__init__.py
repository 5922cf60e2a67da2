"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator is a plain function from DataFrame to
DataFrame; the query registry of the subpackage is :mod:`sparkloom.llm.queries`.
"""
