"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from ledgerloom import fixed  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from ledgerloom.operators import analytics, extract, search  # noqa: E402
from ledgerloom.plans import catalog, jobs  # noqa: E402
from ledgerloom.session import build_session, stage, work_dir  # noqa: E402
from ledgerloom.sources import ledger, requests  # noqa: E402
from ledgerloom.sources.invoices import invoice_text  # noqa: E402

HEADLINE = ["process_documents", "build_postings", "analytics_summary", "upsert_by_hash", "search_topk",
            "vendor_search_batch", "vendor_scan_batch", "flag_duplicates", "language_profile", "export_csv"]


def run(df) -> None:
    """Computes every row and column without collecting them."""
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")

    queries = catalog.all_queries()
    run(queries["by_language"](spark, folder))  # first use of the session is not part of a query
    seconds = {name: timed(lambda n=name: run(queries[n](spark, folder))) for name in HEADLINE}

    # stored tables, as a user has them: search, dashboard and extraction on their own
    rows = stage(ledger.records(spark, folder), "records")
    docs = stage(invoice_text(spark, folder), "documents")
    index_path = work_dir(spark, "index")
    built = timed(lambda: search.write_index(rows, index_path, ["vendor_name"]))
    index = search.open_index(spark, index_path)
    asked = requests.vendor_queries(spark, folder)
    # as many different requests: the vendor's word and the number of a supplier
    distinct = asked.withColumn("vendor", F.concat_ws(" ", "vendor", F.col("query_id").cast("string")))
    n_docs, n_asked = docs.count(), asked.count()
    stored = {
        "extract": timed(lambda: run(extract.extract_fields(docs))),
        "process": timed(lambda: run(jobs.process_documents(docs))),
        "index_build": built,
        "indexed_search": timed(lambda: run(search.search_batch(asked, rows, index, fixed.BATCH_SEARCH_LIMIT))),
        "indexed_search_distinct": timed(lambda: run(search.search_batch(distinct, rows, index, fixed.BATCH_SEARCH_LIMIT))),
        "scan_search_distinct": timed(lambda: run(search.vendor_scan_batch(distinct, rows))),
        "scan_search": timed(lambda: run(search.vendor_scan_batch(asked, rows))),
        "dashboard": timed(lambda: run(analytics.summary(rows))),
    }
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus), "stored_tables": stored,
        "throughput": {
            "extract_documents_per_s": round(n_docs / stored["extract"], 1),
            "process_documents_per_s": round(n_docs / stored["process"], 1),
            "indexed_search_queries_per_s": round(n_asked / stored["indexed_search"], 1),
            "distinct_indexed_search_queries_per_s": round(n_asked / stored["indexed_search_distinct"], 1),
            "scan_search_queries_per_s": round(n_asked / stored["scan_search"], 1),
        },
        "documents": n_docs, "search_queries": n_asked,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
