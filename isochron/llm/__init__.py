"""Training-data operators: ten corpus operators and their queries.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
