"""Training-data operators: ten corpus-scale operators and their queries.

Nothing else in the library imports this subpackage.
"""
