"""Compare registered queries with their SQL oracles over the smallest tables."""

import os
from collections import Counter

TABLES = "/root/testdata/sf0.001"


def compare(spark, queries, oracles):
    import duckdb

    con = duckdb.connect()
    for file in os.listdir(TABLES):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{TABLES}/{file}'")
    wrong = {}
    for name, sql in oracles.items():
        got = queries[name](spark, TABLES)
        columns = sorted(got.columns)
        result = con.execute(sql)
        names = [c[0] for c in result.description]
        want = Counter(tuple(map(repr, (row[names.index(c)] for c in columns))) for row in result.fetchall())
        have = Counter(tuple(map(repr, row)) for row in got.select(*columns).collect())
        if sorted(names) != columns or have != want:
            wrong[name] = (list((have - want).items())[:2], list((want - have).items())[:2])
    return wrong
