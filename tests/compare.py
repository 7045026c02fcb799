"""Run registered queries next to their SQL twins and report differences.

python tests/compare.py sf0.01 [query ...]
"""

from __future__ import annotations

import decimal
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR"}, "boolean": {"BOOLEAN"}, "double": {"DOUBLE"}}


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(rows):
    def value(v):
        return int(v) if isinstance(v, decimal.Decimal) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


def compare(spark, con, name, query, sql, folder) -> list[str]:
    """Differences between the Spark result and the SQL result of one query."""
    df = query(spark, folder)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return [f"columns {cols} != {sorted(rel.columns)}"]
    types = dict(zip(rel.columns, map(str, rel.types)))
    bad = [f"type {c}: {t} != {types[c]}" for c, t in df.dtypes if types[c] not in TYPES.get(t, {t})]
    ours = plain(df.select(*[f"`{c}`" for c in cols]).collect())
    theirs = plain(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql}) z").fetchall())
    if len(ours) != len(theirs):
        bad.append(f"rows {len(ours)} != {len(theirs)}")
    if ours != theirs:
        a, b = set(ours), set(theirs)
        bad.append(f"only spark {len(a - b)}: {sorted(a - b, key=repr)[:2]}")
        bad.append(f"only sql   {len(b - a)}: {sorted(b - a, key=repr)[:2]}")
    return bad


def main() -> None:
    from crawlsift import session
    import __spark_entry__ as entry

    folder, wanted = f"/root/testdata/{sys.argv[1]}", sys.argv[2:]
    spark = session.build(master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        if name not in sql:
            print(f"{name}: no sql, rows {query(spark, folder).count()}", flush=True)
            continue
        try:
            bad = compare(spark, con, name, query, sql[name], folder)
        except Exception as e:  # report and go on with the other queries
            bad = [f"error {str(e)[:600]}"]
        print(f"{'ok  ' if not bad else 'DIFF'} {name} {time.time() - start:.1f}s", flush=True)
        for line in bad:
            print("     ", line[:900], flush=True)


if __name__ == "__main__":
    main()
