"""Run registered queries against the DuckDB oracle locally.

    python -m harvestry.plans.verify /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import json
import sys
import time

from harvestry.plans.catalog import catalog_for
from harvestry.plans.oracle import compare, duckdb_connect, run_oracle
from harvestry.plans.registry import load_all, oracle_text
from harvestry.session import build_session


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    reg = load_all()
    spark = build_session("local[8]")
    con = duckdb_connect(sf_dir)
    bad = 0
    for name, q in reg.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = q.build(catalog_for(spark, sf_dir))
            spdf = sdf.toPandas()
            t1 = time.time()
            if q.sql is None:
                print(json.dumps({"q": name, "rows": len(spdf), "oracle": None, "sec": round(t1 - t0, 2)}))
                continue
            opdf = run_oracle(con, oracle_text(q.sql))
            cmp = compare(spdf, opdf)
            bad += not cmp.ok
            print(json.dumps({"q": name, "ok": cmp.ok, "exact": cmp.exact, "rows": [cmp.rows_spark, cmp.rows_oracle],
                              "sec": round(t1 - t0, 2), "detail": cmp.detail[:300]}))
        except Exception as e:  # report and continue
            bad += 1
            print(json.dumps({"q": name, "error": f"{type(e).__name__}: {str(e)[:400]}"}))
        sys.stdout.flush()
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
