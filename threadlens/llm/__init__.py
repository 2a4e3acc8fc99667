"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one operator with a general interface and the
thin ``opN_*`` query that applies it to the shared tables; ``registry`` collects the queries and their SQL.
"""
