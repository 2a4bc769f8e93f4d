"""Headline timings: one JSON line on stdout.

Each report is run to completion (all rows computed, none kept) and timed as the median of three
warm runs over the stored rollups; building lines and rollups from the tables is timed once each.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import SPECS, all_queries  # noqa: E402
from gondola.operators.filters import apply_filters  # noqa: E402
from gondola.session import local_session  # noqa: E402
from gondola.testbed import Testbed, stores  # noqa: E402

HEADLINES = [
    "a01_ventas", "a05_tickets", "q01_kpis_v", "q02_kpis_t", "q03_treemap", "q05_evol_v",
    "q07_prod_mg", "q08_precio_evol", "q10_compresion", "q11_promos", "q12_heatmap_promo",
    "q14_tiendas_v", "q19_ticket_promo_mes", "q20_ticket_promo_cat", "q21_sku_por_promo",
    "q26_penetracion_prod", "q34_yoy_mes", "q38_cobertura_prod", "q39_resumen_export",
    "f08_stores_to_products", "p05_portfolio", "p11_promo_coverage", "p13_promo_month_matrix",
    "p14_promo_fatigue", "p28_margin_trend", "p35_price_volume_correlation", "p43_promo_ranking",
    "p46_daily_revenue", "p53_catalog_coverage", "p55_yoy_by_category",
]
RUNS = 3


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def scale(sf_dir: str) -> float | str:
    name = os.path.basename(sf_dir).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session("gondola-bench", cores)
    bed = Testbed(spark, sf_dir)
    times = {"build_lines": timed(bed.lines), "build_rollups": timed(bed.rollups)}
    store_table = stores(spark, sf_dir)

    def filtered() -> None:
        with apply_filters(bed.rollups(), store_table, SPECS["f08"]) as chosen:
            run(chosen.productos)

    times["apply_filters"] = statistics.median(timed(filtered) for _ in range(RUNS))
    queries = all_queries()
    for name in HEADLINES:
        def once(query=queries[name]) -> None:
            run(query(spark, sf_dir))

        once()
        times[name] = statistics.median(timed(once) for _ in range(RUNS))
    print(json.dumps({
        "metric": "total_wall_clock", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": {name: round(t, 3) for name, t in times.items()},
        "sf": scale(sf_dir), "cores": int(cores),
        "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
        "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
