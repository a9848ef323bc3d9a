"""Encoding and repair of XML before parsing."""

from __future__ import annotations

import re

#: The first bytes in which a declaration is looked for.
HEAD = 256
DECLARED = re.compile(rb"""encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")
EMPTY_GROUP = re.compile(r"<referenceableParamGroup\b([^>]*?)/>")


def sniffed(data: bytes) -> str:
    m = DECLARED.search(data[:HEAD])
    return m[1].decode("ascii").lower() if m else "utf-8"


def to_utf8(data: bytes) -> bytes:
    """UTF-8 and ASCII stay; windows-1252 is decoded with its undefined bytes replaced; all other charsets count as Latin-1. The declaration follows."""
    charset = sniffed(data)
    if charset in ("utf-8", "utf8", "us-ascii", "ascii"):
        return data
    text = data.decode("cp1252", "replace") if charset in ("windows-1252", "cp1252") else data.decode("latin-1")
    out = text.encode("utf-8")
    return DECLARED.sub(b'encoding="UTF-8"', out[:HEAD], count=1) + out[HEAD:]


def with_open_groups(xml: str) -> str:
    """Self-closing parameter groups become empty pairs, in the header alone."""
    head, sep, rest = xml.partition("<run")
    return EMPTY_GROUP.sub(r"<referenceableParamGroup\1></referenceableParamGroup>", head) + sep + rest
