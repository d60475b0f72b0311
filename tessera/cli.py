"""python -m tessera.cli --inputs FILE_OR_FOLDER ... --config FILE [--out FILE | --lines FOLDER] [--recorded FOLDER] [--live]

Exit codes: 2 for a bad config, 1 for output that breaks it.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tessera.pipeline import run
from tessera.plans.config import ConfigError, load
from tessera.plans.project import OutputValidationError, ProjectionError, write_json, write_json_lines


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("-i", "--inputs", action="append", required=True, help="file or folder; may be given again")
    parser.add_argument("-c", "--config", required=True, help="output program, JSON")
    parser.add_argument("-o", "--out", help="write the JSON here instead of printing it")
    parser.add_argument("--lines", help="write JSON lines to this folder, in parallel and in the file system it names, instead of one JSON array")
    parser.add_argument("--recorded", default="fixtures/github", help="folder of recorded profiles")
    parser.add_argument("--live", action="store_true", help="ask the web service for profiles instead; not repeatable")
    given = parser.parse_args(arguments)
    try:
        config = load(given.config)
    except ConfigError as e:
        print(f"config error: {e}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        result = run(spark, given.inputs, config, given.recorded, given.live)
        text = write_json_lines(result.output, given.lines) if given.lines else write_json(result.output, given.out)
    except (ProjectionError, OutputValidationError) as e:
        print(f"projection error: {e}", file=sys.stderr)
        return 1
    if given.lines is None and given.out is None:
        print(text)
    else:
        print(f"wrote {given.lines or given.out}", file=sys.stderr)
    for note in result.diagnostics:
        print(f"diagnostic: {note}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
