"""Training-data operators: ten corpus operators, their queries and SQL.

Nothing else in the library imports this subpackage.
"""
