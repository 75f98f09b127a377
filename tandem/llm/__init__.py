"""Operators for building and cleaning large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` wires them to the fixture tables.
"""
