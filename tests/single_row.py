"""Helpers of the tests, in a module whose name no conftest can shadow."""


def result_of(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
