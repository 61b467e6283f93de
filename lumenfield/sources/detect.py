"""Which format a file is in."""

from __future__ import annotations

import re

from . import files

FORMATS = ["3dgs", "cc", "compressed_ply", "splat", "ksplat", "spz", "sog", "parquet"]
BY_ENDING = {".parquet": "parquet", ".splat": "splat", ".ksplat": "ksplat", ".spz": "spz", ".sog": "sog"}
SNIFFED = 2048


def detect(path: str) -> str:
    """The format by the path's ending, else by the first bytes; ValueError if neither tells."""
    for ending, name in BY_ENDING.items():
        if path.lower().endswith(ending):
            return name
    text = files.fetch(path, 0, SNIFFED).decode("latin-1")
    if "element chunk" in text:
        return "compressed_ply"
    if "property float f_dc_0" in text:
        return "3dgs"
    if re.search(r"property float (scal_|scalar_scal_|scalar_)f_dc_0", text):
        return "cc"
    raise ValueError(f"the format of {path} can't be told")
