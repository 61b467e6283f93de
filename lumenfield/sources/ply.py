"""PLY headers and bodies: ascii, little and big endian, list properties."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from . import files

#: PLY's names of number types, fixed by the format.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}
NAMES = {"i1": "char", "u1": "uchar", "i2": "short", "u2": "ushort", "i4": "int", "u4": "uint", "f4": "float", "f8": "double"}
#: Bytes in which a header has to end.
MOST_HEADER = 1 << 20


@dataclass
class Element:
    name: str
    count: int
    #: (name, type) or (name, (count type, item type))
    properties: list[tuple] = field(default_factory=list)

    @property
    def lists(self) -> bool:
        return any(isinstance(t, tuple) for _, t in self.properties)

    def dtype(self, order: str) -> np.dtype:
        return np.dtype([(n, order + t) for n, t in self.properties])


@dataclass
class Header:
    kind: str
    elements: list[Element]
    size: int

    @property
    def order(self) -> str:
        return ">" if self.kind == "binary_big_endian" else "<"

    def element(self, name: str) -> Element | None:
        return next((e for e in self.elements if e.name == name), None)

    def offset(self, name: str) -> int:
        """Where an element starts; only behind elements of fixed size."""
        at = self.size
        for e in self.elements:
            if e.name == name:
                return at
            if e.lists:
                raise ValueError(f"{name} stands behind an element with lists")
            at += e.count * e.dtype(self.order).itemsize
        raise KeyError(name)


def header(path: str) -> Header:
    raw = files.fetch(path, 0, MOST_HEADER)
    end = raw.find(b"end_header")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError(f"{path} has no PLY header")
    size = raw.index(b"\n", end) + 1 if b"\n" in raw[end : end + 16] else len(raw)
    kind, elements = "ascii", []
    for line in raw[:end].decode("latin-1").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            elements.append(Element(w[1], int(w[2])))
        elif w[0] == "property":
            elements[-1].properties.append((w[4], (TYPES[w[2]], TYPES[w[3]])) if w[1] == "list" else (w[2], TYPES[w[1]]))
    return Header(kind, elements, size)


def load(path: str, head: Header, wanted: set[str]) -> dict[str, dict[str, list | np.ndarray]]:
    """Whole elements by column; for side tables, ascii files and lists."""
    out: dict[str, dict] = {}
    raw = files.fetch(path, head.size)
    if head.kind == "ascii":
        words = iter(raw.split())
        for e in head.elements:
            columns: dict[str, list] = {n: [] for n, _ in e.properties}
            for _ in range(e.count):
                for n, t in e.properties:
                    if isinstance(t, tuple):
                        k = int(next(words))
                        columns[n].append([float(next(words)) if t[1][0] == "f" else int(next(words)) for _ in range(k)])
                    else:
                        columns[n].append(float(next(words)) if t[0] == "f" else int(next(words)))
            out[e.name] = {n: columns[n] if isinstance(t, tuple) else np.array(columns[n], t) for n, t in e.properties}
    else:
        at = 0
        for e in head.elements:
            if not e.lists:
                kind = e.dtype(head.order)
                rows = np.frombuffer(raw, kind, e.count, at)
                at += e.count * kind.itemsize
                out[e.name] = {n: rows[n].astype(t) for n, t in e.properties}
                continue
            columns = {n: [] for n, _ in e.properties}
            for _ in range(e.count):
                for n, t in e.properties:
                    if isinstance(t, tuple):
                        k = int(np.frombuffer(raw, head.order + t[0], 1, at)[0])
                        at += np.dtype(t[0]).itemsize
                        columns[n].append(np.frombuffer(raw, head.order + t[1], k, at).tolist())
                        at += k * np.dtype(t[1]).itemsize
                    else:
                        columns[n].append(np.frombuffer(raw, head.order + t, 1, at)[0].item())
                        at += np.dtype(t).itemsize
            out[e.name] = {n: columns[n] if isinstance(t, tuple) else np.array(columns[n], t) for n, t in e.properties}
    return {k: v for k, v in out.items() if k in wanted}


def header_bytes(elements: list[Element]) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0"]
    for e in elements:
        lines.append(f"element {e.name} {e.count}")
        lines += [f"property list {NAMES[t[0]]} {NAMES[t[1]]} {n}" if isinstance(t, tuple) else f"property {NAMES[t]} {n}" for n, t in e.properties]
    return ("\n".join([*lines, "end_header"]) + "\n").encode()


def body_bytes(e: Element, columns: dict[str, list | np.ndarray]) -> bytes:
    if not e.lists:
        rows = np.zeros(e.count, e.dtype("<"))
        for n, _ in e.properties:
            rows[n] = columns[n]
        return rows.tobytes()
    out = []
    for i in range(e.count):
        for n, t in e.properties:
            v = columns[n][i]
            out.append(np.array([len(v)], "<" + t[0]).tobytes() + np.array(v, "<" + t[1]).tobytes() if isinstance(t, tuple) else np.array([v], "<" + t).tobytes())
    return b"".join(out)
