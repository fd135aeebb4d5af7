"""Command line: convert files, list formats, write a configuration file."""

from __future__ import annotations

import argparse
from pathlib import Path

from quillstream import __version__
from quillstream.api import convert_files
from quillstream.plans import config as cfg
from quillstream.plans import graph


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillstream", description="Convert documents between formats.")
    p.add_argument("files", nargs="*", help="files or glob patterns")
    p.add_argument("-f", "--format", help="target formats, parted by commas")
    p.add_argument("-o", "--output", help="output directory")
    p.add_argument("-c", "--config", help="configuration file")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--list-formats", action="store_true")
    p.add_argument("--init-config", metavar="PATH", nargs="?", const=str(Path.home() / cfg.USER))
    p.add_argument("--keep-intermediate", action="store_true", help="keep the files between hops")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.init_config:
        cfg.write_default(a.init_config)
        return 0
    if a.list_formats:
        near: dict[str, set[str]] = {}
        for c in graph.CONVERTERS:
            for s in c.inputs:
                near.setdefault(s.upper(), set()).update(x.upper() for x in c.outputs)
        for s in sorted(near):
            print(f"{s} -> {', '.join(sorted(near[s]))}")
        return 0
    if not a.files or not a.format:
        parser().print_help()
        return 0
    names = [p for f in a.files for p in (sorted(map(str, Path().glob(f))) if any(c in f for c in "*?[") and not Path(f).is_absolute() else [f])]
    user = cfg.load(a.config) if a.config else None
    rows = convert_files(names, a.format.split(","), output=a.output, overwrite=a.overwrite, keep_intermediate=a.keep_intermediate, config=user).collect()
    good = sum(r["success"] for r in rows)
    for r in rows:
        if r["success"]:
            hops = f" ({' -> '.join(x.upper() for x in r['conversion_path'])}, {r['hops']} hops)" if a.verbose and r["hops"] > 1 else ""
            print(f"{r['source_path']} -> {r['target_path']}{hops}")
        else:
            print(f"{r['source_path']}: {r['error']}")
    print(f"{good} converted, {len(rows) - good} failed")
    return 0
