"""Numbers and ticks as charts label them, and small text codecs. All work on bounded, driver-side values."""

from __future__ import annotations

import math
import re

#: Prefixes of powers of a thousand, from 10^-24 on.
PREFIXES = ("y", "z", "a", "f", "p", "n", "µ", "m", "", "k", "M", "G", "T", "P", "E", "Z", "Y")


def number(x: float | None, spec: str) -> str:
    """A number by a short spec: ``,`` groups, ``.n`` digits, ``~`` drops closing zeros, and f, %, e, d or s (prefixes)."""
    if x is None or x != x:
        return ""
    if math.isinf(x):
        return "∞" if x > 0 else "-∞"
    m = re.fullmatch(r"(,?)(?:\.(\d{1,2}))?(~?)([f%eds]?)", spec)
    if not m:
        raise ValueError(f"no number format {spec!r}")
    group, digits, trim, kind = m[1], int(m[2]) if m[2] else None, bool(m[3]), m[4] or "f"
    if kind == "d":
        return f"{round(x):{group}d}"
    if kind == "s":
        power = 0 if x == 0 else max(-8, min(8, math.floor(math.log10(abs(x)) / 3)))
        text = f"{x / 1000**power:.{digits if digits is not None else 6}g}" if not trim or digits is not None else f"{x / 1000**power:.6g}"
        return (_trimmed(text) if trim else text) + PREFIXES[power + 8]
    value = x * 100 if kind == "%" else x
    text = f"{value:{group}.{digits if digits is not None else 6 if kind == 'e' else 2}{'e' if kind == 'e' else 'f'}}"
    return (_trimmed(text) if trim else text) + ("%" if kind == "%" else "")


def _trimmed(text: str) -> str:
    return re.sub(r"(\.\d*?)0+(?=e|$)", r"\1", text).replace(".e", "e").rstrip(".") if "." in text else text


def nice_ticks(lo: float, hi: float, count: int = 5) -> list[float]:
    """Ticks within the span at 1, 2 or 5 times a power of ten."""
    from millrace.operators.charts import nice_edges

    lo, hi = min(lo, hi), max(lo, hi)
    if lo == hi:
        pad = abs(lo) * 0.1 or 1.0
        lo, hi = lo - pad, hi + pad
    return [e for e in nice_edges(lo, hi, count) if lo - 1e-12 * (hi - lo) <= e <= hi + 1e-12 * (hi - lo)]


def log_ticks(lo: float, hi: float) -> list[float]:
    """Powers of ten within the span; below two of them also twice and five times."""
    if lo <= 0 or hi < lo:
        raise ValueError("a logarithmic axis needs positive values")
    a, b = math.floor(math.log10(lo)), math.ceil(math.log10(hi))
    powers = [10.0**k for k in range(a, b + 1) if lo <= 10.0**k <= hi]
    if len(powers) >= 2:
        return powers
    return sorted(m * 10.0**k for k in range(a, b + 1) for m in (1, 2, 5) if lo <= m * 10.0**k <= hi)


def unquote_git_path(path: str) -> str:
    """A path as git prints it: in quotes with octal bytes and escapes where it holds unusual characters."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    plain = {"n": 10, "t": 9, "r": 13, '"': 34, "\\": 92, "a": 7, "b": 8, "f": 12, "v": 11}
    out, body, i = bytearray(), path[1:-1], 0
    while i < len(body):
        if body[i] == "\\" and i + 1 < len(body):
            if m := re.match(r"[0-7]{3}", body[i + 1 :]):
                out.append(int(m[0], 8) & 255)
                i += 4
                continue
            if body[i + 1] in plain:
                out.append(plain[body[i + 1]])
                i += 2
                continue
        out += body[i].encode()
        i += 1
    return out.decode("utf-8", "replace")


def diff_stat(numstat: str) -> tuple[int, int, int]:
    """(files, added, removed) of ``git diff --numstat``; binary files count as files only."""
    files = added = removed = 0
    for line in numstat.splitlines():
        if m := re.match(r"(\d+|-)\t(\d+|-)\t.", line):
            files += 1
            added += int(m[1]) if m[1] != "-" else 0
            removed += int(m[2]) if m[2] != "-" else 0
    return files, added, removed


def slice_utf8(text: str, offset: int, size: int) -> tuple[str, int | None]:
    """(part, next offset) of at most ``size`` bytes from a byte offset; characters stay whole, a last line too where one
    ends within."""
    raw = text.encode()
    offset = max(0, min(offset, len(raw)))
    while offset < len(raw) and raw[offset] & 0xC0 == 0x80:
        offset += 1
    end = min(len(raw), offset + max(1, size))
    while end < len(raw) and end > offset and raw[end] & 0xC0 == 0x80:
        end -= 1
    if end < len(raw) and (cut := raw.rfind(b"\n", offset, end)) > offset:
        end = cut + 1
    return raw[offset:end].decode("utf-8", "replace"), end if end < len(raw) else None


def probe(text: str, pattern: str, regex: bool = False, around: int = 80, most: int | None = 50) -> list[tuple[int, str]]:
    """(place, text around) of the hits of a literal (in any case) or a pattern, the first ``most`` or, with None, all."""
    p = re.compile(pattern if regex else re.escape(pattern), 0 if regex else re.I)
    out = []
    for m in p.finditer(text):
        out.append((m.start(), re.sub(r"\s+", " ", text[max(0, m.start() - around) : m.end() + around]).strip()))
        if len(out) == most:
            break
    return out
