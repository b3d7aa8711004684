"""Command line: python -m plumbline [options] file|glob|url|- ...

Prints the pre-hash, if asked for, and then the hashes of each event, one value a line; or writes them beside each file (--batch).
"""

from __future__ import annotations

import argparse
import re
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans.hashing import hash_events
from plumbline.schema import ALGORITHMS, Options
from plumbline.sources import documents


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("plumbline", description="Hashes of supply-chain events in EPCIS documents.")
    p.add_argument("sources", nargs="+", help="files, globs, http(s) URLs, or - for standard input")
    p.add_argument("-a", "--algorithm", default="sha-256", help=f"comma-separated; of {', '.join(ALGORITHMS)}")
    p.add_argument("-p", "--prehash", action="store_true", help="show pre-hashes, too")
    p.add_argument("-j", "--join", default="", help=r"put between the lines of a shown pre-hash; \n and \r are line breaks")
    p.add_argument("-e", "--enforce-format", choices=["json", "xml"], help="whatever the names of the files")
    p.add_argument("-i", "--ignore-fields", default="", help="further fields to leave out, comma-separated")
    p.add_argument("-v", "--cbv-version", default="2.0", choices=["2.0", "2.1", "2.0.0", "2.1.0"])
    p.add_argument("-b", "--batch", action="store_true", help="write .hashes and .prehashes beside each file, or here for a URL")
    return p


def _events(spark: SparkSession, source: str, format: str | None) -> DataFrame:
    if source == "-":
        return documents.from_stdin(spark, format=format or "json")
    if re.match(r"https?://", source):
        return documents.from_url(spark, source, format=format)
    return documents.read(spark, source, format=format)


def _target(source: str) -> Path:
    return Path(source.rstrip("/").rsplit("/", 1)[1]) if re.match(r"https?://", source) else Path(source.removeprefix("file:"))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0, or 1 if an event or document was bad (said on standard error)."""
    own = arguments()
    args = own.parse_args(argv)
    if args.batch and "-" in args.sources:
        own.error("standard input has no place to write beside")
    spark = spark or SparkSession.builder.getOrCreate()
    o = Options.of(hash_algorithm=args.algorithm, prehash=args.prehash, ignore_fields=args.ignore_fields, cbv_version=args.cbv_version)
    o = Options(o.algorithms, o.exclude, args.join.replace(r"\n", "\n").replace(r"\r", "\r"), o.version)
    bad = 0
    for source in args.sources:
        rows = hash_events(_events(spark, source, args.enforce_format), o).orderBy("source_file", "event_ord")
        if args.batch:
            # Files are begun anew when their first event comes.
            begun: set[Path] = set()
        for r in rows.toLocalIterator():
            if r["error"]:
                bad = 1
                print(f"{r['source_file']}: event {r['event_ord']}: {r['error']}", file=sys.stderr)
                continue
            for name in o.algorithms:
                if not args.batch:
                    print(r[name])
                    continue
                at = _target(r["source_file"])
                at = at.with_name(f"{at.stem}.{'prehashes' if name == 'prehash' else 'hashes'}")
                with at.open("a" if at in begun else "w") as f:
                    f.write(f"{r[name]}\n")
                begun.add(at)
    return bad


if __name__ == "__main__":
    sys.exit(main())
