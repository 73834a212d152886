"""What several test modules share."""

def rows(df):
    """Rows as a sorted list of tuples of text, columns by name."""
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else repr(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None))
