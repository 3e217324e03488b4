"""Training-data pipeline operators.

A self-contained subpackage: nothing else in ``gaugeworks`` imports it.
Each operator lives in its own module and takes a DataFrame plus column
names; ``queries`` binds them to the ``documents`` table.
"""
