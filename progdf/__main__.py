"""python -m progdf {cfg,cdg,ddg,cg,all} PATH: relations of a package, or of one compiled file, as one JSON record of counts.

Exit 0: done; 1: the analysis failed; 2: wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys

PARTS = {"cfg": ("instructions", "cfg"), "cdg": ("post_dominance", "cdg"), "ddg": ("ddg_nodes", "ddg"), "cg": ("call_graph", "points_to")}


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="progdf", description=__doc__)
    p.add_argument("relation", choices=[*PARTS, "all"])
    p.add_argument("path")
    p.add_argument("--no-profile", action="store_true")
    p.add_argument("--include", help="regular expression that the relative paths of sources have to contain")
    p.add_argument("--dot", help="folder for DOT documents of the control-flow graphs")
    a = p.parse_args(args)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from progdf.functions import dot
    from progdf.functions.profile import Profiler
    from progdf.functions.scratch import saved
    from progdf.operators import evaluate, lower
    from progdf.sources import ingest

    spark = SparkSession.builder.appName("progdf").config("spark.ui.enabled", "false").getOrCreate()
    prof = Profiler()
    try:
        with prof.region("load"):
            compiled = a.path.endswith(".pyc")
            files = ingest.files(spark, a.path, "*.pyc" if compiled else "*.py", (lambda rel: rel.rlike(a.include)) if a.include else None)
            root = "" if compiled else ingest.source_root(files)
            rel = F.expr("substring(rel, 5)") if root else F.col("rel")
            files = (files.where("rel LIKE 'src/%'") if root else files).withColumn("module", ingest.module_name(rel))
            codes = saved(ingest.load_pyc(files) if compiled else ingest.compile_sources(files), "codes")
            ids = saved(ingest.with_ids(codes), "codes")
            if ids.isEmpty():
                raise ValueError("no source could be compiled")
        with prof.region("analyze"):
            out = lower.analyze(ids)
            wanted = [r for k, v in PARTS.items() if a.relation in (k, "all") for r in v]
            counts = {r: out[r].count() for r in wanted}
        if a.dot:
            dot.write_lines(dot.cfg_document(out["instructions"], out["cfg"]), "document", a.dot)
        record = {"schema_version": 2, "codes": ids.count(), "failures": ingest.failures(codes).count(), **counts}
        if not a.no_profile:
            record["profiling"] = [r.asDict() for r in evaluate.phase_costs(prof.records(spark)).orderBy("phase").collect()]
        print(json.dumps(record))
        return 0
    except Exception as e:  # the exit code tells
        print(f"progdf: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
