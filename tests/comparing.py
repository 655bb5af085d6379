"""Rows of a DataFrame and of a DuckDB query, in one form."""


def rows_of(df):
    """Rows by sorted column names, sorted."""
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
