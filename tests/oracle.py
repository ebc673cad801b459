"""Compare registered queries with their SQL on the same Parquet tables.

    python tests/oracle.py [--sf 0.01] [--explain] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canon(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dict):
        return tuple((k, canon(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return repr(float(value))
    return str(value) if value is not None else None


def kind(type_name: str) -> str:
    """Coarse type family shared by both engines' type names."""
    t = type_name.lower()
    if t.startswith(("bigint", "int", "hugeint", "smallint", "long", "tinyint", "ubigint")):
        return "int"
    if t.startswith(("varchar", "string")):
        return "string"
    return t.split("(")[0]


def compare(spark, con, name: str, sf_dir: str, queries, oracle) -> tuple[str, str]:
    df = queries[name](spark, sf_dir)
    left_cols = sorted(df.columns)
    rows = df.select(*left_cols).collect()
    if name not in oracle:
        return ("rows", f"{len(rows)} rows, no SQL")
    left = Counter(tuple(canon(v) for v in r) for r in rows)
    result = con.execute(oracle[name])
    names = [d[0] for d in result.description]
    right_cols = sorted(names)
    if left_cols != right_cols:
        return ("FAIL", f"columns {left_cols} vs {right_cols}")
    left_kinds = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    right_kinds = {d[0]: kind(str(d[1])) for d in result.description}
    order = [names.index(c) for c in right_cols]
    right = Counter(tuple(canon(r[i]) for i in order) for r in result.fetchall())
    types = [f"{c}:{left_kinds[c]}/{right_kinds[c]}" for c in left_cols if left_kinds[c] != right_kinds[c]]
    if left != right:
        only_l = list((left - right).items())[:2]
        only_r = list((right - left).items())[:2]
        n = sum((left - right).values()), sum((right - left).values())
        return ("FAIL", f"rows {sum(left.values())}/{sum(right.values())} differ {n}\n   spark {only_l}\n   sql   {only_r} {types}")
    return ("ok", f"{sum(left.values())} rows" + (f" types {types}" if types else ""))


def main() -> int:
    import __spark_entry__ as entry
    from pitspark.session import build_session

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "oracle", "local[8]", 8, **{"spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            if args.explain:
                queries[name](spark, sf_dir).explain("formatted")
                continue
            status, note = compare(spark, con, name, sf_dir, queries, oracle)
        except Exception as e:  # report and go on with the next query
            status, note = "ERROR", f"{type(e).__name__}: {str(e)[:1500]}"
        bad += status in ("FAIL", "ERROR")
        print(f"{status:5} {name:28} {time.time() - start:6.2f}s  {note}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
