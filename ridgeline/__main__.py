"""Command line: python -m ridgeline COMMAND ...

Over a library folder: ingest ROOT FOLDER, score ROOT, calibrate ROOT, clips ROOT, rank ROOT [--by KEY] [--top N], inventory ROOT,
buckets ROOT, log ROOT, label ROOT [TEXT] [--style S] [--mount M], archive ROOT FOLDER, restore ROOT FOLDER, relink ROOT FOLDER,
verify ROOT [TEXT], errors ROOT, timing ROOT, retime ROOT, level ROOT, orient ROOT,
recordings ROOT, listed ROOT, fit ROOT, migrate ROOT; calibrate --approximate takes sketches.
Over tables: list, show NAME DIR [--top N], write NAME DIR PATH [--csv].
"""

from __future__ import annotations

import argparse
import sys

from ridgeline import plans
from ridgeline.library import Library
from ridgeline.operators import calibration, catalogue
from ridgeline.session import session
from ridgeline.sources.files import write_csv

#: Commands over a library, with what they take beside its folder.
LIBRARY = {"ingest": ["folder"], "score": [], "calibrate": [], "clips": [], "rank": [], "inventory": [], "buckets": [], "log": [], "label": [], "archive": ["folder"], "restore": ["folder"], "verify": [], "errors": [], "timing": [], "relink": ["folder"], "retime": [], "level": [], "orient": [], "recordings": [], "listed": [], "fit": [], "migrate": []}


def parse(args: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="ridgeline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of the queries")
    show = commands.add_parser("show", help="print a query's first rows")
    write = commands.add_parser("write", help="write a query's rows")
    for p in (show, write):
        p.add_argument("name", choices=sorted(plans.QUERIES))
        p.add_argument("dir", help="folder with the tables")
    show.add_argument("--top", type=int, default=20)
    write.add_argument("path")
    write.add_argument("--csv", action="store_true", help="one CSV with a header instead of Parquet")
    for name, more in LIBRARY.items():
        p = commands.add_parser(name, help=f"{name} of a library")
        for x in ("root", *more):
            p.add_argument(x)
        if name in ("calibrate", "clips"):
            p.add_argument("--weights", help="such as rough=0.8,turn=0.2")
        if name == "calibrate":
            p.add_argument("--approximate", action="store_true", help="percentiles from bounded sketches")
        if name == "verify":
            p.add_argument("text", nargs="?")
        if name == "rank":
            p.add_argument("--by", choices=("clip", "top30", "floor"), default="clip")
            p.add_argument("--top", type=int)
        if name == "label":
            p.add_argument("text", nargs="?")
            p.add_argument("--style")
            p.add_argument("--mount")
    return parser.parse_args(args)


def over_library(own: argparse.Namespace) -> None:
    library = Library(session(), own.root)
    weights = calibration.parse_weights(own.weights) if getattr(own, "weights", None) else None
    if own.command == "ingest":
        print(f"{library.ingest(own.folder)} new")
    elif own.command == "score":
        library.score()
    elif own.command == "calibrate":
        library.calibrate(weights, own.approximate).show(truncate=False)
    elif own.command == "fit":
        for found in library.fit():
            found.show(1000, truncate=False)
    elif own.command == "migrate":
        print(f"was at version {library.migrate()}")
    elif own.command == "verify":
        library.verify(own.text).show(1000, truncate=False)
    elif own.command == "clips":
        print(f"{library.clips(weights)} segments")
    elif own.command == "rank":
        library.rank(own.by, own.top).show(own.top or 1000, truncate=False)
    elif own.command == "label":
        if own.style or own.mount:
            print(f"{library.label(own.text, own.style, own.mount)} changed")
        else:
            catalogue.label_counts(library.table("assets")).orderBy("style", "mount").show(1000, truncate=False)
    else:
        found = getattr(library, own.command)(*([own.folder] if LIBRARY[own.command] else []))
        found.show(1000, truncate=False)


def main(args: list[str] | None = None) -> int:
    own = parse(args)
    if own.command == "list":
        print("\n".join(sorted(plans.QUERIES)))
    elif own.command in LIBRARY:
        over_library(own)
    else:
        df = plans.QUERIES[own.name](session(), own.dir)
        if own.command == "show":
            df.show(own.top, truncate=False)
        elif own.csv:
            write_csv(df, own.path)
        else:
            df.write.mode("overwrite").parquet(own.path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
