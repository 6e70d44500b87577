"""Spans in texts, counted in code points, and what is said of them."""

from __future__ import annotations

import hashlib


def joined(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by the order of ``kinds``, comma-joined; a span is (start, end, kind)."""
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def apart(spans: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that touch none of ``base``."""
    taken, out, i, upto = sorted(base), [], 0, 0
    for a, b, k in sorted(spans):
        while i < len(taken) and taken[i][0] < b:
            upto = max(upto, taken[i][1])
            i += 1
        # every base span that begins before b is behind; it touches if the furthest end reaches past a
        if upto <= a:
            out.append((a, b, k))
    return out


def replaced(text: str, spans: list[tuple[int, int, str]], marks: dict[str, str]) -> str:
    """The text with every span replaced by its kind's mark; of overlapping spans the first mark stands for all."""
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += [text[at:a], marks[k]]
        at = max(at, b)
    return "".join(out) + text[at:]
