"""python -m keyloom.cli bench | gen | bench-files: builds and lookups over generated keys, with timings."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from keyloom.operators.build import ALGORITHMS, build
from keyloom.plans import routing
from keyloom.session import ensure_importable
from keyloom.sources import entry_files, files


def _timed(index_of, probe, n: int, queries: int) -> dict:
    began = time.time()
    index = index_of()
    built = time.time() - began
    began = time.time()
    found = index.lookup(probe, payload=index.payload_size > 0).agg(F.sum((F.col("status") == "OK").cast("int"))).first()[0]
    looked = time.time() - began
    stats = index.stats().first()
    return {"keys": n, "build_s": round(built, 3), "keys_per_s": round(n / built), "queries": queries, "found": found, "lookup_s": round(looked, 3), "queries_per_s": round(queries / looked), "bits_per_key": round(stats.bits_per_key, 3), "algorithm": stats.algorithm}


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="keyloom")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("bench", "gen", "bench-files"):
        p = sub.add_parser(name)
        p.add_argument("--keys", type=int, default=1_000_000)
        p.add_argument("--algorithm", choices=sorted(ALGORITHMS), default="bijection")
        p.add_argument("--payload", type=int, default=4)
        p.add_argument("--fingerprint", type=int, default=1)
        p.add_argument("--queries", type=int, default=100_000)
        p.add_argument("--files", type=int, default=8)
        p.add_argument("--sorted", action="store_true")
        p.add_argument("--workers", type=int)
        if name != "bench":
            p.add_argument("--dir", required=True)
    a = parser.parse_args(args)
    spark = ensure_importable(SparkSession.builder.appName("keyloom").getOrCreate())
    if a.command == "gen":
        made = entry_files.write_entries(entry_files.synthetic(spark, a.keys), a.dir, a.files, a.sorted)
        print(json.dumps({"entries": made.agg(F.sum("entries")).first()[0]}))
        return
    if a.command == "bench":
        keys = entry_files.synthetic(spark, a.keys)
    elif a.sorted:
        # each file is a stream of its own, and the streams are merged
        keys = routing.merged(*[entry_files.read_entries(spark, path) for path in files.matching(f"{a.dir}/*.bin")])
    else:
        keys = entry_files.read_entries(spark, f"{a.dir}/*.bin")
    probe = keys.select("key").limit(a.queries)
    n = a.keys if a.command == "bench" else keys.count()
    print(json.dumps(_timed(lambda: build(keys, payload="payload", payload_size=a.payload, fingerprint_size=a.fingerprint, algorithm=a.algorithm, workers=a.workers), probe, n, min(n, a.queries))))


if __name__ == "__main__":
    main()
