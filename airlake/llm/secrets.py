"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

*Patterns.*  Assignments to secret names, access keys, long hexadecimal runs.

*Battery.*  Every run of at least ``SHORTEST`` characters of ``A-Za-z0-9+/_=-`` that holds a letter, whatever stands beside it, is read in the narrowest encoding that fits.
Runs are cut at ``=`` but for padding at their end; a part with both ``+/`` and ``_-`` is cut at the two that leave the longest piece.
A chi-squared test of uniform use of the alphabet, a runs test about its middle and a lag-one serial correlation
give three p-values, combined by Fisher's method: large for what looks random.

*Control.*  How often ordinary writing looks that random depends on encoding and length, so it is measured on the corpus
itself: every document gives decoys, its own characters within each alphabet, from the whole text
without the runs under test, in consecutive pieces.  Alphabets that at most
a quarter of the text belongs to give pieces of every length class; of the others the pieces take the classes in turn, from one that the text's hash picks.
For each encoding and length class the cut-off is the loosest at which the rate of decoys, times
all candidates, is at most ``RATE`` of the candidates that pass.  Only that fixed-size histogram reaches the driver.

*Few decoys.*  A class of fewer than ``FEW`` decoys uses, in this order, what first has as many: the same writing in capitals (for encodings of capitals),
the shorter classes of its encoding, their writing in capitals.  If none has, the uniform null decides: from ``SURE_LENGTH`` characters on, where writing
does not look random, runs with p of a thirtieth or more are told; shorter ones are not.

Defined cases: a null text counts as empty; added spans never touch a pattern's; repeated rows count like others; ids
are only kept, null or not; texts of any length are scanned whole; only the text and the columns to keep are read; an empty table gives an empty result.  Redaction puts ``[SECRET]`` in place of every span.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm.common import released, slices, table
from airlake.llm.registry import query
from airlake.llm.spans import apart, joined, replaced

KINDS = ("assign", "access", "hex", "random")
MARK = "[SECRET]"
_ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A whole run, since a run of 32 is a match from its first character.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

SHORTEST = 20
LENGTHS = (20, 24, 32, 48, 64, 96)
RATE = 0.05
#: The least number of decoys at which any cut-off can exist, and some more.
FEW = 40
#: Without decoys: runs of this length on are told up to this class of the p-value.
SURE_LENGTH, SURE_CLASS = 48, 2
#: Bytes of text that a task works on at a time: decoys of all alphabets take some forty times as much.
SLICE = 1 << 20
#: p-values below ten to the minus half of this are one class.
WORST = 12
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
#: A part of a run; padding belongs to the last one.
_PART = re.compile(r"[^=]+(=+\Z)?")
_MIXED = (re.compile(r"[^+/=]+(=+\Z)?"), re.compile(r"[^_=-]+(=+\Z)?"))
#: Encodings, narrowest first.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "abcdefghijklmnopqrstuvwxyz0123456789",
    "upper36": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "letters": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_NAMED = list(ENCODINGS)
_FITS = [re.compile(f"[{re.escape(a)}]+") for a in ENCODINGS.values()]
_NOT = [bytes(sorted({*range(256)} - {*a.encode()})) for a in ENCODINGS.values()]
_CAPITALS = [i for i, a in enumerate(ENCODINGS.values()) if not re.search("[a-z]", a)]


def _places(alphabet: str) -> np.ndarray:
    out = np.zeros(128, np.int64)
    out[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return out


_PLACE = [_places(a) for a in ENCODINGS.values()]
_WIDTH = [len(a) for a in ENCODINGS.values()]


def encoding(run: str) -> int | None:
    """Number of the narrowest encoding of a run without its padding; None for numbers and mixtures."""
    body = run.rstrip("=")
    if body.isdigit():
        return None
    return next((i for i, fits in enumerate(_FITS) if fits.fullmatch(body)), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(body: str, kind: int) -> float:
    """Combined p-value of the battery under uniform random characters."""
    v, k, n = _PLACE[kind][np.frombuffer(body.encode(), np.uint8)], _WIDTH[kind], len(body)
    count = np.bincount(v, minlength=k)
    chi = float((count * count).sum()) * k / n - n
    uniform = _two_sided((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    high = 2 * v >= k
    many = int(high.sum())
    few = n - many
    if many and few:
        mean = 1 + 2 * many * few / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        turns = _two_sided((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(spread)) if spread > 0 else 1.0
    else:
        turns = 2.0 ** (1 - n)
    d = v - v.mean()
    square = float((d * d).sum())
    serial = _two_sided((float((d[1:] * d[:-1]).sum()) / square + 1 / n) * math.sqrt(n)) if square else 0.0
    x = -sum(math.log(max(p, 1e-30)) for p in (uniform, turns, serial))  # half of Fisher's statistic, six degrees of freedom
    return math.exp(-x) * (1 + x + x * x / 2)


def _length_class(n: int) -> int:
    return sum(n >= x for x in LENGTHS) - 1


def _class(p: float) -> int:
    return min(WORST, int(-2 * math.log10(max(p, 1e-30))))


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns: leftmost, non-overlapping in each kind."""
    out = []
    low = text.lower()
    if any(w in low for w in _NAMES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def parts(run: str) -> Iterator[tuple[int, str]]:
    """(start, part) of a run: between signs of equality, each in characters of one encoding."""
    for m in _PART.finditer(run):
        body = m[0].rstrip("=")
        if ("+" in body or "/" in body) and ("_" in body or "-" in body):
            ways = [[(m.start() + c.start(), c[0]) for c in some.finditer(m[0])] for some in _MIXED]
            yield from max(ways, key=lambda way: max((len(p.rstrip("=")) for _, p in way), default=0))
        else:
            yield m.start(), m[0]


def candidates(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(start, end, encoding, length class, class of the p-value) of the runs that the battery judges."""
    for m in _RUN.finditer(text):
        for at, part in parts(m[0]):
            body = part.rstrip("=")
            if len(body) >= SHORTEST:
                kind = encoding(body)
                if kind is not None:
                    yield m.start() + at, m.start() + at + len(part), kind, _length_class(len(body)), _class(randomness(body, kind))


def classes(bodies: bytes, n: int, kind: int) -> np.ndarray:
    """``_class(randomness(..))`` of many pieces of ``n`` characters, one after the other."""
    k, out = _WIDTH[kind], []
    every = _PLACE[kind][np.frombuffer(bodies, np.uint8)].reshape(-1, n)
    tail = lambda z: np.array([math.erfc(x) for x in (np.abs(z) / math.sqrt(2)).tolist()])
    for at in range(0, len(every), 10_000):
        v = every[at:at + 10_000]
        rows = len(v)
        count = np.bincount((v + k * np.arange(rows)[:, None]).ravel(), minlength=rows * k).reshape(rows, k)
        chi = (count * count).sum(1) * k / n - n
        uniform = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
        high = 2 * v >= k
        many = high.sum(1)
        mean = 1 + 2 * many * (n - many) / n
        spread = (mean - 1) * (mean - 2) / (n - 1)
        z = (1 + (high[:, 1:] != high[:, :-1]).sum(1) - mean) / np.sqrt(np.where(spread > 0, spread, 1))
        turns = np.where((many == 0) | (many == n), 2.0 ** (1 - n), np.where(spread > 0, tail(z), 1.0))
        d = v - v.mean(1, keepdims=True)
        square = (d * d).sum(1)
        serial = np.where(square > 0, tail(((d[:, 1:] * d[:, :-1]).sum(1) / np.where(square > 0, square, 1) + 1 / n) * math.sqrt(n)), 0.0)
        x = -sum(np.log(np.maximum(p, 1e-30)) for p in (uniform, turns, serial))
        p = np.exp(-x) * (1 + x + x * x / 2)
        out.append(np.minimum(WORST, (-2 * np.log10(np.maximum(p, 1e-30))).astype(int)))
    return np.concatenate(out) if out else np.zeros(0, int)


def decoys(texts: list[str]) -> Counter:
    """(1, or 2 for writing in capitals; encoding, length class, class of the p-value) of the documents' own characters in every alphabet."""
    found: dict[tuple[int, int, int], list[bytes]] = {}
    for text in texts:
        raw = text.encode("ascii", "ignore")
        first = zlib.crc32(raw) % len(LENGTHS)
        shout = raw.upper()
        for source, kind in [*((1, i) for i in range(len(_NOT))), *((2, i) for i in _CAPITALS)]:
            body = (raw if source == 1 else shout).translate(None, _NOT[kind])
            if len(body) < SHORTEST:
                continue
            if 4 * len(body) <= len(text):
                for size, n in enumerate(LENGTHS):
                    if len(body) >= n:
                        found.setdefault((source, kind, size), []).append(body[:len(body) // n * n])
                continue
            at, turn = 0, first
            while len(body) - at >= SHORTEST:
                # the end of a text goes to the longest class that it can fill
                size = min(turn % len(LENGTHS), _length_class(len(body) - at))
                found.setdefault((source, kind, size), []).append(body[at:at + LENGTHS[size]])
                at, turn = at + LENGTHS[size], turn + 1
    seen: Counter = Counter()
    for (source, kind, size), some in found.items():
        for c, n in enumerate(np.bincount(classes(b"".join(some), LENGTHS[size], kind)).tolist()):
            if n:
                seen[source, kind, size, c] += n
    return seen


def calibrate(docs: DataFrame, text_col: str = "text", rate: float = RATE) -> dict[tuple[int, int], int]:
    """Cut-off class by (encoding, length class) from the whole corpus; absent where nothing may be told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                rest = []
                for text in part.column(0).to_pylist():
                    if text:
                        judged = list(candidates(text))
                        seen.update((0, *c[2:]) for c in judged)
                        # a corpus with many keys must not take them for its writing
                        edge = [0, *(i for c in judged for i in c[:2]), len(text)]
                        rest.append(" ".join(text[a:b] for a, b in zip(edge[::2], edge[1::2])) if judged else text)
                seen.update(decoys(rest))
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.int32()) for i in range(4)] + [pa.array(list(seen.values()), pa.int64())],
                                         names=["decoy", "kind", "size", "class", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(lambda b: released(run(b)), "decoy int, kind int, size int, class int, n long")
    hist = np.zeros((3, len(ENCODINGS), len(LENGTHS), WORST + 1))
    for r in found.groupBy("decoy", "kind", "size", "class").agg(F.sum("n").alias("n")).collect():
        hist[r.decoy, r.kind, r["size"], r["class"]] = r.n
    told, fake, loud = (np.cumsum(h, -1) for h in hist)
    cut = {}
    for kind, size in np.ndindex(*told.shape[:2]):
        t = told[kind, size]
        pools = [fake[kind, size], loud[kind, size], fake[kind, :size + 1].sum(0), loud[kind, :size + 1].sum(0)]
        d = next((p for p in pools if p[-1] >= FEW), None)
        if t[-1] and d is None and LENGTHS[size] >= SURE_LENGTH:
            cut[int(kind), int(size)] = SURE_CLASS
        elif t[-1] and d is not None:
            good = np.flatnonzero((t > 0) & ((d + 1) / d[-1] * t[-1] <= rate * t))
            good = good[good < WORST]
            if good.size:
                cut[int(kind), int(size)] = int(good[-1])
    return cut


def scan(docs: DataFrame, cut: dict[tuple[int, int], int], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and n_assign, n_access, n_hex, base, spans, redacted of every document."""
    d = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    names = [*d.columns[1:], "n_assign", "n_access", "n_hex", "base", "spans", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = dict.fromkeys(KINDS, MARK)
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                counts, base_out, spans_out, texts = [], [], [], []
                for text in part.column(0).to_pylist():
                    text = text or ""
                    base = pattern_spans(text)
                    more = [(a, b, "random") for a, b, kind, size, c in candidates(text) if c <= cut.get((kind, size), -1)]
                    spans = base + apart(more, base)
                    counts.append([sum(s[2] == k for s in base) for k in KINDS[:3]])
                    base_out.append(joined(base, KINDS))
                    spans_out.append(joined(spans, KINDS))
                    texts.append(replaced(text, spans, marks) if spans else text)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)], pa.array(base_out, pa.string()),
                     pa.array(spans_out, pa.string()), pa.array(texts, pa.string())], names=names)

    kinds = ", ".join(f"{c} {t}" for c, t in d.dtypes[1:])
    out = d.mapInArrow(lambda b: released(run(b)), f"{kinds}, n_assign long, n_access long, n_hex long, base string, spans string, redacted string")
    return out.withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, calibrate(docs)).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
