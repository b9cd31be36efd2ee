"""Rows of both engines in one form."""


def shown(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return f"{value:.8g}"
    if hasattr(value, "item"):
        return shown(value.item())
    return str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(shown(row[k]) or "" for k in order) for row in values)


def same(spark_df, duck_result):
    mine = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    theirs = rows([d[0] for d in duck_result.description], duck_result.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
