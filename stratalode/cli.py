"""Command line: a checked-out repository in, a report and, if asked for, packages out.

Exit codes: 0 done, 1 an error, 2 wrong usage, 3 a token that may write, 4 bad input,
5 nothing to read, 130 interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys
import traceback
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalode import __version__, analysis
from stratalode.functions.constants import LANGUAGE_BY_EXT
from stratalode.operators import extract, graph, report, scan, search
from stratalode.sources.files import from_directory

ERROR, AUTH, BAD_INPUT, REPO, INTERRUPTED = 1, 3, 4, 5, 130
#: From so many files on a run is announced as slow, and a language filter proposed.
MANY_FILES, VERY_MANY_FILES = 50_000, 150_000


class Failure(Exception):
    def __init__(self, code: int, message: str) -> None:
        super().__init__(message)
        self.code = code


def arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="stratalode", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("folder", help="the checked-out repository")
    p.add_argument("--repo", required=True, help="owner/name or address, for names and links")
    p.add_argument("--output", default="report.md", help="the report's file")
    p.add_argument("--max-candidates", type=int, default=10, help="cards in the report")
    p.add_argument("--min-score", type=float, default=0.0, help="score from which candidates are shown, 0 to 10")
    p.add_argument("--min-stars", type=int, default=5, help="stars from which a project counts as similar")
    p.add_argument("--language", choices=sorted(set(LANGUAGE_BY_EXT.values())), help="only files of one language")
    p.add_argument("--projects", metavar="TABLE", help="parquet catalogue of projects to compare with")
    p.add_argument("--no-network", action="store_true", help="compare with no projects, even if there is a catalogue")
    p.add_argument("--extract", metavar="FOLDER", help="write packages of the best candidates")
    p.add_argument("--max-extract", type=int, default=5, help="packages to write")
    p.add_argument("--extract-min-score", type=float, default=6.0, help="score from which packages are written")
    p.add_argument("--scopes", help="scopes header of the token in use; one that may write is refused")
    p.add_argument("--token-variable", default="SOURCE_HOST_TOKEN", metavar="NAME", help="environment variable of the token in use, which no message shows")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--verbose", action="store_true", help="tell each step")
    p.add_argument("--debug", action="store_true", help="show where errors come from")
    p.add_argument("--version", action="version", version=f"stratalode {__version__}")
    return p.parse_args(argv)


def checked(a: argparse.Namespace) -> None:
    """What can be told without reading anything."""
    parent = os.path.dirname(os.path.abspath(a.output))
    faults = [
        (os.path.isdir(a.output), f"--output is a folder: {a.output}"), (not os.path.isdir(parent), f"--output lies in no folder: {parent}"),
        (bool(a.extract) and "://" not in a.extract and os.path.exists(a.extract) and not os.path.isdir(a.extract), f"--extract is no folder: {a.extract}"),
        (a.max_candidates < 1, "--max-candidates must be 1 at least"), (a.max_extract < 1, "--max-extract must be 1 at least"), (not 0 <= a.min_score <= 10, "--min-score must be 0 to 10"),
    ]
    for wrong, message in faults:
        if wrong:
            raise Failure(BAD_INPUT, message)
    if not os.path.isdir(a.folder):
        raise Failure(REPO, f"{a.folder} is no folder")


def run(a: argparse.Namespace) -> None:
    tell = (lambda text: print(text)) if a.verbose else (lambda text: None)
    warn = lambda text: print(f"Warning: {text}", file=sys.stderr)
    checked(a)
    spark = SparkSession.builder.master(a.master).appName("stratalode").getOrCreate()
    told = spark.createDataFrame([(a.repo, a.scopes)], "arg string, scopes string").select(scan.parse_repo_arg(F.col("arg")).alias("p"), scan.scope_check(F.lit(200), F.col("scopes"), F.lit("")).alias("c")).first()
    if told["p"]["error"]:
        raise Failure(BAD_INPUT, f"{a.repo} is no owner/name")
    if a.scopes is not None and not told["c"]["ok"]:
        raise Failure(AUTH, told["c"]["error"])
    repo = f"{told['p']['owner']}/{told['p']['name']}"
    tell("Scanning files")
    files = graph.cut_lineage(from_directory(spark, a.folder, repo))
    n = files.count()
    if not n:
        raise Failure(REPO, "no files found")
    tell(f"  {n} files")
    if n > MANY_FILES:
        warn(f"{n:,} files; this may take a while" + (", --language would help" if n > VERY_MANY_FILES else ""))
    main_language = scan.primary_language(files).first()["language"]
    if a.language and main_language not in (a.language, "Unknown"):
        warn(f"most lines are {main_language}; only {a.language} is looked at")
    if a.language and not scan.of_language(files, a.language).limit(1).count():
        raise Failure(REPO, f"no {a.language} files found")
    tell("Detecting and scoring candidates")
    now = datetime.now(UTC)
    projects = spark.read.parquet(a.projects) if a.projects and not a.no_network else None
    found, errors = analysis.examine(files, a.language, projects, now.strftime("%Y-%m-%d"), a.min_stars)
    found = graph.cut_lineage(found)
    counts = found.agg(F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped")).alias("active")).first()
    tell(f"  {counts['active']} candidates, {counts['skipped']} skipped")
    if failed := errors.count():
        warn(f"{failed} file(s) made a parser fail and were left out")
    if projects is not None and (refused := sum(r["rate_limited"] for r in search.rate_limited(found).collect())):  # one repository
        warn(f"{refused} search(es) were refused; uniqueness of those is neutral")
    if a.extract:
        tell("Writing packages")
        picked = graph.cut_lineage(extract.chosen(found, a.max_extract, a.extract_min_score))
        folder = a.extract if "://" in a.extract else f"file://{os.path.abspath(a.extract)}"
        written = extract.write_packages(extract.package_files(picked, files), folder).count()
        print(f"{picked.count()} package(s), {written} files written to {a.extract}")
        for r in extract.manifest(picked).collect():  # at most --max-extract
            print(f"  {r['package']:30s}  score={r['score']:.1f}  type={r['extraction_type']}")
    tell("Writing the report")
    text = report.render(found, repo, a.language or main_language, now.strftime("%Y-%m-%dT%H:%M:%SZ"), a.max_candidates, a.min_score)
    with open(a.output, "w", encoding="utf-8") as out:
        out.write(text)
    best = report.ranked(found, 1, a.min_score).first()
    print(f"Report written: {a.output}" + (f"; best: {best['path']} ({best['combined_score']:.1f}/10)" if best else ""))


def redacted(message: str, a: argparse.Namespace) -> str:
    """A message without the token in it; the same rule as ``scan.redact``, where no session may be left to ask."""
    token = os.environ.get(a.token_variable, "")
    return message.replace(token, "***") if token else message


def main(argv: list[str] | None = None) -> int:
    try:
        a = arguments(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        run(a)
    except Failure as e:
        print(f"Error: {redacted(str(e), a)}", file=sys.stderr)
        return e.code
    except KeyboardInterrupt:
        print("Interrupted.", file=sys.stderr)
        return INTERRUPTED
    except Exception as e:  # the last place to tell it
        print(f"Error: {redacted(str(e), a)}", file=sys.stderr)
        if a.debug:
            print(redacted(traceback.format_exc(), a), file=sys.stderr)
        return ERROR
    return 0


if __name__ == "__main__":
    sys.exit(main())
