"""Compares a query with its SQL, order aside."""

import math
import os
from decimal import Decimal

import duckdb


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    return ("nan" if math.isnan(value) else round(value, 6)) if isinstance(value, float) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con, sql):
    found = con.execute(sql)
    return table([c[0] for c in found.description], found.fetchall())
