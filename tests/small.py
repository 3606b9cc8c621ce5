"""Helpers for small results."""


def rows(df):
    """All rows of a small result as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
