"""Format detection by path and content."""

from __future__ import annotations

import zipfile
from pathlib import Path

#: The end of the name of an archive's index member.
INDEX = "_index.json"


class UnsupportedFormat(Exception):
    """The input is known, but needs a proprietary library; runners count it as skipped."""


#: Formats whose data only a vendor's library decodes.
PROPRIETARY = {"tdf": "Bruker TDF frames", "baf": "Bruker BAF", "agilent": "Agilent .d", "shimadzu": "Shimadzu .lcd", "sciex": "SciEX .wiff", "waters": "Waters .raw", "thermo": "Thermo .raw"}


def index_member(z: zipfile.ZipFile) -> str | None:
    return next((n for n in z.namelist() if "/" not in n and n.endswith(INDEX)), None)


def detect(path: str) -> str:
    """One of archive, mzml, imzml, tsf, agilent_profile, or a key of PROPRIETARY; ValueError if unknown.

    A Waters ``.raw`` is a folder with a header or function files, a Thermo
    ``.raw`` a file; TSF counts only without TDF beside it.
    """
    p = Path(path)
    name = p.name.lower()
    if p.is_dir():
        names = {x.name.lower() for x in p.iterdir()}
        if "analysis.tdf" in names:
            return "tdf"
        if "analysis.tsf" in names:
            return "tsf"
        if "analysis.baf" in names:
            return "baf"
        if name.endswith(".d") and "acqdata" in names:
            return "agilent_profile" if all((p / "AcqData" / x).is_file() for x in ("MSScan.xsd", "MSScan.bin", "MSProfile.bin")) else "agilent"
        if name.endswith(".raw") and ("_header.txt" in names or any(x.startswith("_func") and x.endswith(".dat") for x in names)):
            return "waters"
        raise ValueError(f"unknown folder: {path}")
    if name.endswith((".mzml", ".mzml.gz")):
        return "mzml"
    for end, kind in ((".imzml", "imzml"), (".lcd", "shimadzu"), (".wiff", "sciex"), (".wiff2", "sciex"), (".raw", "thermo")):
        if name.endswith(end):
            return kind
    if p.is_file() and zipfile.is_zipfile(p):
        with zipfile.ZipFile(p) as z:
            if index_member(z):
                return "archive"
    raise ValueError(f"unknown file: {path}")


def guard(path: str) -> str:
    kind = detect(path)
    if kind in PROPRIETARY:
        raise UnsupportedFormat(f"{PROPRIETARY[kind]} needs the vendor's library; convert {path} to mzML first")
    return kind
