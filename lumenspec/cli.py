"""Command line: inspect, filter and convert."""

from __future__ import annotations

import argparse
import json
import sys

from lumenspec.operators.selection import parse_range
from lumenspec.sources.detect import UnsupportedFormat, guard


GRID = ("off", "auto", "on")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lumenspec")
    p.add_argument("input")
    p.add_argument("-o", "--output")
    p.add_argument("--inspect", action="store_true")
    p.add_argument("--rt", type=parse_range, help="minutes, lo-hi, either side open")
    p.add_argument("--ms-level", type=int, action="append", default=[])
    p.add_argument("--drop", action="append", default=[], help="glob of members to drop")
    p.add_argument("--no-vendor", action="store_true", help="drop the vendor's side files of an archive")
    p.add_argument("--sdrf", help="a table of samples and data files to put into a new archive")
    p.add_argument("--image", action="append", default=[], help="an optical image to put into a new archive; one beside an imzML file is found by its name")
    p.add_argument("--mobility-table", action="store_true", help="write what the scans of a TDF folder stand for as CSV, read from its side tables only")
    p.add_argument("--layout", choices=("point", "chunk"), help="of the signal in a new archive")
    p.add_argument("--chunk-size", type=float, help="m/z range of a chunk")
    p.add_argument("--grid", nargs="?", const="auto", choices=GRID, help="store spectra on a shared lattice by their indexes; on: fail where there is none")
    p.add_argument("--no-chromatograms", action="store_true", help="leave the chromatograms of the input out")
    p.add_argument("--config", help="a YAML file of the options below; the command line goes first")
    p.add_argument("--max-spectra", type=int)
    p.add_argument("--force", action="store_true")
    return p


#: Options that a file may give, with their types; switches can be turned on by either side.
SETTINGS = {"output": str, "force": bool, "no_vendor": bool, "no_chromatograms": bool, "sdrf": str, "layout": str, "chunk_size": float, "grid": str}


def with_config(args: argparse.Namespace) -> argparse.Namespace:
    """The arguments, with a file's settings where they are not given; an unknown key or a wrong type is an error."""
    if not args.config:
        return args
    with open(args.config, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml

        held = yaml.safe_load(text)
    except ImportError:  # JSON is YAML too
        held = json.loads(text or "{}")
    if not isinstance(held or {}, dict):
        raise ValueError(f"no settings: {args.config}")
    for key, value in (held or {}).items():
        if key == "grid" and isinstance(value, bool):  # YAML reads on and off so
            value = "on" if value else "off"
        if key not in SETTINGS:
            raise ValueError(f"unknown setting: {key}")
        if value is None:
            continue
        number = SETTINGS[key] is float and isinstance(value, int) and not isinstance(value, bool)
        if not (isinstance(value, SETTINGS[key]) or number):
            raise ValueError(f"setting {key} is no {SETTINGS[key].__name__}")
        if key == "layout" and value not in ("point", "chunk"):
            raise ValueError(f"no layout: {value}")
        if key == "grid" and value not in GRID:
            raise ValueError(f"no grid mode: {value}")
        given = getattr(args, key)
        setattr(args, key, given or value if SETTINGS[key] is bool else value if given is None else given)
    return args


def _mobility(args) -> int:
    from pathlib import Path

    from lumenspec.operators import mobility
    from lumenspec.session import session
    from lumenspec.sources import sidetables, sqlite

    file, meta = str(Path(args.input) / "analysis.tdf"), sqlite.global_metadata(args.input) or {}
    if not args.output or not Path(file).exists() or "OneOverK0AcqRangeLower" not in meta:
        print("a mobility table needs a TDF folder with its range, and an output", file=sys.stderr)
        return 1
    spark, columns = session(), "id long, model_type int, " + ", ".join(f"c{k} double" for k in (0, 1, 2, 3, 6, 7))
    models = None
    if "TimsCalibration" in sqlite.tables(file):
        stored = columns.replace("id ", "Id ").replace("model_type", "ModelType").replace("c", "C")
        models = sqlite.read(spark, file, "TimsCalibration", stored).toDF(*(c.split()[0] for c in columns.split(", ")))
    low, high = (float(meta[f"OneOverK0AcqRange{end}"]) for end in ("Lower", "Upper"))
    frames = sidetables.frame_table(spark, file)
    if frames is None:
        print("no table of frames", file=sys.stderr)
        return 1
    mobility.write_table(mobility.mobility_table(frames, low, high, models), args.output, args.force)
    return 0


def _side(spark, args, kind: str):
    """What puts a table of samples and optical images into an archive."""
    from lumenspec.sources.sinks import discovered_image, embed_images, pixel_grid

    samples = _samples(spark, args.sdrf)
    found = discovered_image(args.input) if kind == "imzml" else None

    def add(out):
        if samples:
            samples(out)
        embed_images(out, args.image, [found] if found else [], pixel_grid(args.input) if kind == "imzml" else None)

    return add


def _samples(spark, file: str | None):
    """What puts a table of samples into an archive, or nothing."""
    if not file:
        return None
    from pyspark.sql import functions as F

    from lumenspec.functions.text import accession_hint
    from lumenspec.sources.sinks import embed_sdrf

    accession = spark.range(1).select(accession_hint(F.lit(file))).first()[0]
    return lambda out: embed_sdrf(out, file, accession)


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: failed; 3: a format that needs a vendor's library."""
    args = parser().parse_args(argv)
    try:
        args = with_config(args)
        if args.chunk_size is not None and not args.chunk_size > 0:
            raise ValueError("a chunk's range is positive")
        if args.mobility_table:
            return _mobility(args)
        kind = guard(args.input)
    except UnsupportedFormat as e:
        print(e, file=sys.stderr)
        return 3
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    from lumenspec.session import session
    from lumenspec.sources import archive, members, mzml, profile, sinks

    if kind != "archive" and (args.rt or args.ms_level or args.drop or args.no_vendor):
        print("these filters are for archives", file=sys.stderr)
        return 1
    if (args.sdrf or args.image) and (kind == "archive" or not args.output or args.output.lower().endswith(".mzml")):
        print("a table of samples and images go into a new archive", file=sys.stderr)
        return 1
    drop = (*args.drop, "vendor*") if args.no_vendor else tuple(args.drop)
    spark = session()
    read = {"imzml": mzml.read_imzml, "agilent_profile": lambda s, path: profile.spectra_of(profile.read_profiles(s, path))}.get(kind, mzml.read_mzml)
    if args.inspect:
        if kind == "archive":
            for name, member in members.members(args.input).items():  # counts are in the footers
                print(name, member.rows())
        else:
            print("spectra", read(spark, args.input).count())
        return 0
    if not args.output:
        print("an output is needed", file=sys.stderr)
        return 1
    written = args.output.lower().endswith(".mzml")
    if kind == "archive" and not written:
        archive.filter_archive(spark, args.input, args.output, args.rt, tuple(args.ms_level), drop, args.force)
        return 0
    traces = None
    if kind == "archive":
        from lumenspec.operators.selection import survivors
        from lumenspec.sources import decode

        spectra = survivors(decode.read_spectra(spark, args.input, drop), args.rt, args.ms_level)
    else:
        spectra, traces = read(spark, args.input), None if args.no_chromatograms or kind == "agilent_profile" else mzml.read_chromatograms(spark, args.input)
    if args.max_spectra:
        spectra = spectra.orderBy("index").limit(args.max_spectra)
    if written:
        sinks.write_mzml(spectra, args.output, traces)
    else:
        try:
            archive.write_archive(spectra, args.output, args.force, traces, _side(spark, args, kind), args.layout or "point", args.chunk_size or 50.0, args.grid or "off")
        except ValueError as e:
            print(e, file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
