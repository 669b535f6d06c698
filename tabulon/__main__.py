"""Command line: ``python -m tabulon convert SOURCE... [-o DEST] [--format ...]``."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tabulon")
    c = p.add_subparsers(dest="command", required=True).add_parser("convert", help="convert files between formats")
    c.add_argument("source", nargs="+")
    c.add_argument("-o", "--output")
    c.add_argument("--format")
    c.add_argument("--columns", type=lambda s: s.split(","))
    c.add_argument("--dtype", action="append", default=[], metavar="NAME=DTYPE")
    c.add_argument("--rename", action="append", default=[], metavar="OLD=NEW")
    c.add_argument("--output-dir")
    c.add_argument("--batch-size")
    c.add_argument("--no-compact", action="store_true")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("--on-mismatch", choices=["strict", "drop"], default="strict")
    c.add_argument("--max-workers", default=None)
    c.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    from .sources.formats import convert

    pairs = lambda xs: dict(x.split("=", 1) for x in xs)
    workers = int(a.max_workers) if (a.max_workers or "").isdigit() else a.max_workers
    size = int(a.batch_size) if (a.batch_size or "").isdigit() else a.batch_size
    done = convert(a.source if len(a.source) > 1 else a.source[0], a.output, format=a.format, columns=a.columns, dtypes=pairs(a.dtype) or None, rename=pairs(a.rename) or None, output_dir=a.output_dir, batch_size=size, compact=not a.no_compact, overwrite=a.overwrite, on_mismatch=a.on_mismatch, max_workers=workers, dry_run=a.dry_run)
    for d in done if isinstance(done, list) else [done]:
        print(d)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
