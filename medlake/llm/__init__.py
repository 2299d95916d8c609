"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries.py`` holds the thin
registered queries and ``oracle.py`` their SQL.
"""
