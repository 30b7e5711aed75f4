"""Compare every named query with its SQL twin: python tests/check_oracles.py [dir] [names...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from cardwatch.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{d}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = [
        tuple("" if v is None or v is pd.NA or v != v else (repr(float(v)) if isinstance(v, float) else str(v)) for v in r)
        for r in df.astype(object).itertuples(index=False)
    ]
    return sorted(rows)


def compare(spark, con, d: str, name: str) -> tuple[bool, str]:
    got = queries()[name](spark, d).toArrow().to_pandas(types_mapper=pd.ArrowDtype)
    want = con.execute(oracle_sql()[name]).to_arrow_table().to_pandas(types_mapper=pd.ArrowDtype)
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if got[c].dtype != want[c].dtype}
    a, b = canonical(got), canonical(want)
    if a != b:
        diff = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return False, f"rows {len(a)} vs {len(b)}; only here {diff[0]}; only there {diff[1]}; types {kinds}"
    return True, f"{len(a)} rows" + (f" (types {kinds})" if kinds else "")


def main() -> int:
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(queries())
    spark, con = local_session("8"), connect(d)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracle_sql():
                ok, note = compare(spark, con, d, name)
            else:
                ok, note = True, f"rows only: {queries()[name](spark, d).count()}"
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
