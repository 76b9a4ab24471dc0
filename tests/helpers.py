"""Small panels from NumPy arrays (NaN becomes NULL)."""

import datetime as dt

import numpy as np

START = dt.date(2020, 1, 1)


def day(i: int) -> dt.date:
    return START + dt.timedelta(days=int(i))


def val(x):
    return None if x is None or np.isnan(x) else float(x)


def book(spark, z, r, adtv=None, beta=None, sectors=None):
    """Book table of dense (rows x names) arrays."""
    z, r = np.asarray(z, float), np.asarray(r, float)
    t, n = z.shape
    full = lambda a, d: np.full((t, n), d) if a is None else np.asarray(a, float)
    adtv, beta = full(adtv, 1e12), full(beta, 0.0)
    rows = [(day(i), i, f"T{j:03d}", val(z[i, j]), val(r[i, j]), val(adtv[i, j]), val(beta[i, j]),
             sectors[j] if sectors else f"S{j}") for i in range(t) for j in range(n)]
    return spark.createDataFrame(rows, "date date, idx int, ticker string, w double, r double, adtv double, beta double, sector string")


def wide(df, value="w"):
    """Collected (rows x names) array in name order; NULL becomes NaN."""
    p = df.toPandas().pivot(index="idx", columns="ticker", values=value).sort_index()
    return p
