"""Training-data operators: one module per operator, its queries in ``queries``.

Nothing outside this package imports it.
"""
