"""Comparing rows of Spark and DuckDB."""


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, ordered(tuple(r[c] for c in cols) for r in df.collect())


def duck_rows(rel):
    cols = sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    return cols, ordered(tuple(r[i] for i in at) for r in rel.fetchall())
