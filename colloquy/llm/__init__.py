"""Operators for preparing language-model training data, as Spark jobs.

Nothing outside this folder imports it.  Each module holds one operator with
its own interface; `queries` applies the operators to the driver's tables and
derives the contract columns.
"""
