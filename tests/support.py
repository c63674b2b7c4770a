"""Helpers shared by the tests."""


def rows(df, *cols):
    out = df.select(*cols) if cols else df
    return sorted(tuple(r) for r in out.collect())
