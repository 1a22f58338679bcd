"""Training-data operators: one module per operator, queries in ``queries``.

Nothing outside this package (and the top-level corpus pipeline) imports it.
"""
