"""Operators for preparing language-model training data at scale.

Nothing outside this subpackage imports it.  ``quillet.llm.queries`` lists the
registered queries and their SQL twins.
"""
