"""Command-line check: python tests/check.py <sf_dir> [name ...]"""

from __future__ import annotations

import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import importlib

from tests.harness import compare, connect
from veil.plans import registry
from veil.session import build_session


def main() -> None:
    sf = sys.argv[1]
    mods = [a[1:] for a in sys.argv[2:] if a.startswith("@")]
    wanted = [a for a in sys.argv[2:] if not a.startswith("@")]
    if mods:
        for m in mods:
            importlib.import_module(f"veil.plans.{m}")
    else:
        registry.load()
    spark = build_session("check", "local[8]", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="veil-check-"), "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name, e in registry.REGISTRY.items():
        if mods and e.build.__module__.rsplit('.', 1)[-1] not in mods:
            continue
        if wanted and name not in wanted:
            continue
        t = time.time()
        try:
            df = registry.callable_for(e)(spark, sf)
            n = compare(df, con, e.oracle) if e.oracle else len(df.collect())
            print(f"{'ok  ' if e.oracle else 'rows'} {name} rows={n} {time.time() - t:.2f}s", flush=True)
            if n == 0:
                print(f"     EMPTY {name}")
        except Exception as ex:
            failed.append(name)
            print(f"FAIL {name} {time.time() - t:.2f}s {str(ex)[:700]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print("failed:", failed)


if __name__ == "__main__":
    main()
