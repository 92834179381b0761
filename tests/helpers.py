"""Small grids for the tests."""

from gridloom.operators.grid import GridSpec, to_stack


def stack_of(spark, series, nrow=1, times=()):
    """A stack of the given series, cell by cell."""
    n = len(series[0])
    rows = [("g", i + 1, t + 1, None if v is None else float(v)) for i, s in enumerate(series) for t, v in enumerate(s)]
    long = spark.createDataFrame(rows, "grid_id string, cell long, t int, value double")
    return to_stack(long, GridSpec(nrow, len(series) // nrow, n, times))


def field_of(spark, values, nrow):
    ncol = len(values) // nrow
    rows = [("g", i + 1, i // ncol + 1, i % ncol + 1, None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "grid_id string, cell long, row int, col int, x double"), GridSpec(nrow, ncol, 1)


def pvalues_of(spark, values):
    return spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "grid_id string, id long, p double")


def by_cell(df, *columns):
    """cell -> value, or tuple of values."""
    return {r["cell"]: r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns) for r in df.select("cell", *columns).collect()}
