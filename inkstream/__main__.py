"""python -m inkstream: run a registered query over a folder of tables, or follow detections."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from .session import session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="inkstream", description=__doc__)
    p.add_argument("--master", default="local[*]")
    commands = p.add_subparsers(dest="command", required=True)
    q = commands.add_parser("query", help="run a registered query")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--out", help="write Parquet here instead of showing rows")
    commands.add_parser("list", help="names of the registered queries")
    f = commands.add_parser("follow", help="track the detections of a Parquet table")
    f.add_argument("detections")
    f.add_argument("out")
    f.add_argument("--config", help="JSON file of settings")
    a = p.parse_args(argv)
    from .plans import catalog, pipelines, registry  # noqa: F401

    if a.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    spark = session(spark__master=a.master)
    if a.command == "query":
        df = registry.QUERIES[a.name](spark, a.folder)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show()
    else:
        settings = pipelines.Settings.read(json.loads(Path(a.config).read_text())) if a.config else pipelines.Settings()
        pipelines.follow(spark.read.parquet(a.detections), settings).write.mode("overwrite").parquet(a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
