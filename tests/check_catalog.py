"""Compare catalog queries with DuckDB: python tests/check_catalog.py [sf] [name ...]"""

from __future__ import annotations

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import TESTDATA, compare, connect  # noqa: E402

from skein.plans.fixtures import Fixtures  # noqa: E402
from skein.plans.registry import CATALOG  # noqa: E402
from skein.session import build_session  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    here = os.path.join(os.path.dirname(__file__), "..", "skein", "plans")
    for name in sorted(os.listdir(here)):
        if name.startswith("catalog_"):
            importlib.import_module(f"skein.plans.{name[:-3]}")
    modules = [w[1:] for w in wanted if w.startswith("@")]
    names = [w for w in wanted if not w.startswith("@")]
    spark = build_session(
        "check",
        "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
         "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"{TESTDATA}/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, q in CATALOG.items():
        if wanted and name not in names and q.run.__module__.split("_")[-1] not in modules:
            continue
        start = time.time()
        try:
            df = q.run(Fixtures(spark, sf_dir))
            if q.sql is None:
                n = df.count()
                ok, note = n > 0, f"{n} rows (no SQL)"
            else:
                ok, note = compare(df, con, q.sql)
        except Exception as err:  # report and go on
            ok, note = False, f"{type(err).__name__}: {str(err)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name}: {note} [{time.time() - start:.1f}s]", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
