"""What the tests of this folder share besides the session."""


def rows(df, *columns):
    """The rows as a sorted list of tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
