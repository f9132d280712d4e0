"""argosift: evidence analytics on Spark DataFrames.

The library is a set of ``DataFrame -> DataFrame`` operators and Column builders.
Nothing here keeps state outside Spark; iterative operators cut their lineage with
``checkpoint()`` in the folder the session names (see :mod:`argosift.runtime`).
"""
