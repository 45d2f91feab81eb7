"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
all cores). The LMS tables are first stored as a deployment holds them; that load
is timed apart. The first run of a query is a warm-up; then the best of
``REPEATS`` runs counts. The no-op sink computes every column of every row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_checks  # noqa: E402
from lectern.session import build_session, drop_path, scratch_path  # noqa: E402
from lectern.sources import LmsTables  # noqa: E402

HEADLINE = (
    "registro_usuarios",
    "ingresos_sistema",
    "matriculas_lms",
    "usuarios_ambiente",
    "fichas_programas",
    "trafico_diario",
    "uso_herramientas",
    "participacion_herramientas",
    "tiempo_permanencia",
    "sesiones_online",
    "cat_registro_usuarios",
    "cat_participacion",
    "cat_tiempo_herramienta",
    "rollup_login_day",
    "rollup_tool_activity_day",
    "rollup_estimated_time_day",
    "rollup_traffic_hour",
    "export_part_assign",
)
REPEATS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks = all_checks()
    root = scratch_path(spark, "lms")
    start = time.perf_counter()
    tables = LmsTables.from_star(spark, folder).store(root)
    load = time.perf_counter() - start
    times: dict[str, float] = {}
    for key in HEADLINE:
        best = None
        for turn in range(REPEATS + 1):
            start = time.perf_counter()
            checks[key].over(tables).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - start
            if turn:
                best = spent if best is None else min(best, spent)
        times[key] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "load_seconds": round(load, 3),
                "sf": os.path.basename(folder.rstrip("/")),
            }
        ),
        flush=True,
    )
    drop_path(spark, root)
    spark.stop()


if __name__ == "__main__":
    main()
