"""Run catalog queries next to their SQL twins and report differences.

    python tests/compare.py [sf_dir] [name ...]

COMPARE_CONF holds further Spark settings as key=value pairs joined by semicolons.
"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from chatloom.plans.fixtures import TABLES  # noqa: E402

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double",
         "TIMESTAMP": "timestamp_ntz", "JSON": "string"}


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def differences(df, con, sql):
    """A short text per difference; empty when columns, types and rows agree."""
    names = sorted(df.columns)
    ours = sorted((tuple(r) for r in df.select(*names).collect()), key=_key)
    cur = con.execute(sql)
    theirs_names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    if sorted(theirs_names) != names:
        return [f"columns {names} vs {sorted(theirs_names)}"], len(ours)
    order = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=_key)
    out = []
    for name, kind in df.dtypes:
        if KINDS.get(types[name], types[name]) != kind:
            out.append(f"type of {name}: {kind} vs {types[name]}")
    if len(ours) != len(theirs):
        out.append(f"rows {len(ours)} vs {len(theirs)}")
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
        out.append(f"{len(bad)} rows differ, first: {str(bad[0])[:600] if bad else ''}")
    return out, len(ours)


def main(argv):
    from chatloom.session import build_session
    from __spark_entry__ import oracle_sql, queries

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(queries())
    conf = dict(pair.split("=", 1) for pair in os.environ.get("COMPARE_CONF", "").split(";") if pair)
    spark = build_session("compare", "local[8]", 8, {"spark.ui.enabled": "false", **conf})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, failed = duck(sf_dir), oracle_sql(), 0
    for name in names:
        started = time.time()
        try:
            df = queries()[name](spark, sf_dir)
            if name in oracle:
                diff, n = differences(df, con, oracle[name])
            else:
                diff, n = [], df.count()
        except Exception as error:
            diff, n = [f"{type(error).__name__}: {str(error)[:700]}"], 0
        failed += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {n} rows {time.time() - started:.1f}s {'' if name in oracle else '(no oracle)'}", flush=True)
        for d in diff:
            print("     ", d, flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv))
