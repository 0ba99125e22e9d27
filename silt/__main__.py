"""python -m silt run|validate|generate: YAML pipelines, and generated rows as JSON lines."""

from __future__ import annotations

import argparse
import sys

from silt.plans import config


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="silt")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("run", "validate"):
        verbs.add_parser(verb).add_argument("config")
    g = verbs.add_parser("generate")
    g.add_argument("n", type=int)
    g.add_argument("--complexity", default="simple")
    p.add_argument("--master", default=None)
    p.add_argument("--spool", default="silt-spool", help="the folder of what receivers take, shared with the executors")
    a = p.parse_args(args)
    if a.verb != "generate":
        with open(a.config, encoding="utf-8") as f:
            try:
                pipelines = config.load(f.read())
            except config.ConfigError as e:
                print(f"error: {e}", file=sys.stderr)
                return 1
    from silt.session import session
    from silt.sinks import deliver
    from silt.sources import generator

    spark = session(a.master)
    if a.verb == "validate":
        for name, pipeline in pipelines.items():
            try:
                planned = config.validate(spark, pipeline, name)
            except (config.ConfigError, ValueError, OSError) as e:
                print(f"error: {e}", file=sys.stderr)
                return 1
            for of, schema in planned.items():
                print(f"ok: {name} {of} {schema}")
        return 0
    if a.verb == "generate":
        deliver.to_stdout(generator.logs(spark, a.n, complexity=a.complexity), "json")
    else:
        served = []
        for name, pipeline in pipelines.items():
            if pipeline.inputs[0]["type"] in config.PUSHED:
                served.append(config.serve(spark, pipeline, f"{a.spool}/{name}"))
            else:
                config.run(spark, pipeline)
        try:
            for s in served:
                for q in s.queries:
                    q.awaitTermination()
        except KeyboardInterrupt:
            for s in served:
                s.close()
    return 0


if __name__ == "__main__":
    sys.exit(main())
