"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of Parquet tables, ``BENCH_CPUS`` the local cores. Every
result is computed whole (no-op sink); a few untimed runs warm the engine up first.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tablero import catalog
from tablero.session import local_session

# Run once per report; jobs that write tables are timed too, the rest of the keys repeat these.
SKIPPED = {"q24_arr", "q25_churn", "q26_cohortes", "q21_pronostico", "gen_nombre", "gen_email",
           "gen_telefono"}

WARM_UP = ["q23_export_hechos", "v_ventas_por_categoria", "v_segmentacion_clientes"]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tablero-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    wanted = sys.argv[1:] or [key for key in queries if key not in SKIPPED]

    def run(key: str) -> float:
        started = time.perf_counter()
        queries[key](spark, path).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    for key in WARM_UP:
        run(key)
    seconds = {key: run(key) for key in wanted}
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(path.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
