"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it.  ``graphloom.llm.queries`` holds
the registered queries and their SQL.
"""
