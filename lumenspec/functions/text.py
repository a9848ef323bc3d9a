"""Text expressions: globs, names, XML attributes, paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes of side files that are compressed when embedded.
COMPRESSIBLE = (".xml", ".txt", ".method", ".tsf", ".tdf", ".json", ".csv", ".sqlite", ".cfg", ".ini", ".log")
#: Media types by extension.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "svs": "image/tiff"}


def glob_regex(pattern: str, single: bool = False) -> str:
    """The anchored expression of a glob in which ``*`` spans anything, slashes included, and ``?`` one character if ``single``."""
    wild = {"*": ".*"} | ({"?": "."} if single else {})
    return "^" + "".join(wild.get(c) or re.escape(c) for c in pattern) + "$"


def member_matches(path: Column, pattern: str) -> Column:
    """Archive members: the full path, case-sensitive."""
    return path.rlike("(?s)" + glob_regex(pattern))


def side_file_matches(path: Column, pattern: str) -> Column:
    """Vendor side files: the file name only, in any case."""
    return F.lower(F.element_at(F.split(path, "/"), -1)).rlike("(?s)" + glob_regex(pattern.lower(), single=True))


def policy(path: Column, overrides: list[tuple[str, str]], base: list[tuple[str, str]], lossless: bool) -> Column:
    """embed or drop: the first override that matches, then binary blobs of lossless lanes, then the base rules, else embed."""
    rules = [*overrides, *([("*_bin", "drop")] if lossless else []), *base]
    out = None
    for pattern, action in rules:
        hit = side_file_matches(path, pattern)
        out = F.when(hit, action) if out is None else out.when(hit, action)
    return F.lit("embed") if out is None else out.otherwise("embed")


def compressible(path: Column) -> Column:
    return F.lower(path).rlike("(" + "|".join(re.escape(s) for s in COMPRESSIBLE) + ")$")


def safe_member(path: Column) -> Column:
    """Whether a path is relative, without parent steps, back slashes, drive letters or control characters."""
    return (F.length(path) > 0) & ~path.rlike(r"^/|^[A-Za-z]:|\\|[\x00-\x1f]|(^|/)\.\.(/|$)")


def sanitized_label(label: Column) -> Column:
    """ASCII letters and digits kept, runs of others one underscore, none at the ends; ``col`` if nothing is left."""
    bare = F.btrim(F.regexp_replace(label, "[^0-9A-Za-z]+", "_"), F.lit("_"))
    return F.when(bare == "", "col").otherwise(bare)


def slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def scrubbed(argument: Column) -> Column:
    """An argument that holds a path separator becomes its last part."""
    return F.regexp_replace(argument, r"^.*[/\\]", "")


def accession_hint(path: Column) -> Column:
    """The stem of a file less a second extension where that begins like a public accession, else the stem."""
    stem = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", "")
    bare = F.regexp_replace(stem, r"\.[^.]*$", "")
    return F.when(bare.rlike("^(PXD|MTBLS|MSV)"), bare).otherwise(stem)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_type(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for ext, kind in MEDIA.items():
        out = F.when(extension(path) == ext, kind).otherwise(out)
    return out


def xml_attribute(xml: Column, tag: str, name: str) -> Column:
    """The value of an attribute of the first such tag, outside comments."""
    bare = F.regexp_replace(xml, r"(?s)<!--.*?-->", "")
    return F.nullif(F.regexp_extract(bare, rf'(?s)<{tag}\b[^>]*?\s{name}="([^"]*)"', 1), F.lit(""))


def cv_value(xml: Column, accession: str) -> Column:
    """The value of the cvParam with an accession, both in one tag, in any order."""
    tag = F.regexp_extract(xml, rf'(?s)<cvParam\b[^>]*accession="{accession}"[^>]*>', 0)
    return F.nullif(F.regexp_extract(tag, r'\svalue="([^"]*)"', 1), F.lit(""))


def number(value: Column) -> Column:
    """The trimmed value as a double if it is one."""
    return F.trim(value).try_cast("double")


def timestamp(value: Column) -> Column:
    return F.try_to_timestamp(value)
