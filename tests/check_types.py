"""Command line: list columns whose Spark and oracle types are of a different kind."""

import sys

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

from harness import duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from corrobora.session import build_session  # noqa: E402


def kind(t):
    t = t.lower()
    if t.endswith("[]") or t.startswith("array"):
        return "list"
    if t.startswith(("int", "bigint", "long", "smallint", "tinyint", "uint", "ubig", "hugeint")):
        return "big" if t.startswith(("bigint", "long")) else ("huge" if t.startswith("huge") else "int")
    if t.startswith("decimal"):
        return "decimal"
    if t.startswith(("double", "float")):
        return "double"
    if t.startswith(("varchar", "string")):
        return "str"
    return t.split("_")[0].split("(")[0]


spark = build_session("types", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"})
spark.sparkContext.setLogLevel("ERROR")
folder = "/root/testdata/sf0.001"
con = duck(folder)
for name, sql in entry.oracle_sql().items():
    want = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    got = {n: kind(t) for n, t in entry.queries()[name](spark, folder).dtypes}
    bad = {c: (got[c], want.get(c)) for c in got if got[c] != want.get(c)}
    if bad:
        print(name, bad, flush=True)
