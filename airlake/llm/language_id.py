"""Language identification in two levels: the family first, then linear support vector machines within it.

Features are hashed letter n-grams of the whole lower-case text (2, 3 and 4 bytes of UTF-8; all that isn't a letter counts
as a gap), as square roots of counts, scaled to length 1.  One-versus-one machines separate every two families, and
within a family every two languages; votes decide, then summed margins, then the name.

Learning uses a bounded sample: at most ``PER_LANG`` distinct labelled texts with letters of each language, the smallest by a keyed hash of the
text, so copies change nothing and the sample is the same at every layout of the table.  Each machine is trained in a task of its own.
Prediction covers every whole text and reads nothing but the text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, and so is every text if there is nothing to learn
from; null labels are not learned; repeated rows are predicted like any other; texts of any length are read whole; votes and margins that tie
follow the name; only the text and the columns to keep are read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.llm.common import publish, released, slices, table, utf8
from airlake.llm.registry import query

PER_LANG = 400
#: Sampled documents of a family that a machine between families sees.
PER_FAMILY = 800
#: Bytes of text that a task works on at a time: its arrays take some fifty times as much.
SLICE = 1 << 20
DIMS = 1 << 13
UNKNOWN = "und"
#: Families of common language codes.  A code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nb", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
_LETTER = re.compile(r"[^\W\d_]")
_GAP = 32
_MAP = np.arange(256, dtype=np.uint32)
_MAP[[i for i in range(128) if not chr(i).isalpha()]] = _GAP


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes), lang)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; numbers of all kinds are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def vectors(column: pa.Array) -> np.ndarray:
    """One row of ``DIMS`` features per text."""
    at, raw = utf8(pc.utf8_lower(pc.fill_null(column, "")))
    b = np.concatenate((_MAP[raw], np.full(4, _GAP, np.uint32)))
    n = len(raw)
    out = np.zeros((len(at) - 1, DIMS), np.float32)
    h, hashed = b[:n] * np.uint32(0x9E3779B1), []
    for size in (2, 3, 4):
        h = (h ^ b[size - 1:n + size - 1]) * np.uint32(0x85EBCA6B) ^ (h >> np.uint32(15))
        hashed.append((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 13))
    solid = ~((b[:n] == _GAP) & (b[1:n + 1] == _GAP))
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
        keep = solid[s:e]
        for size, ids in zip((2, 3, 4), hashed):
            if e - s >= size:
                out[i] += np.bincount(ids[s:e - size + 1][keep[:e - s - size + 1]], minlength=DIMS)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def train(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights and, last, the intercept of a linear support vector machine (dual coordinate descent); y is +1 or -1."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), axis=1)
    w, alpha = np.zeros(x.shape[1], np.float64), np.zeros(len(x))
    square, rng = (x * x).sum(axis=1), np.random.default_rng(len(x))
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (w @ x[i]) - 1) / square[i], 0.0), cost)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w.astype(np.float32)


class Machines:
    """One-versus-one machines over some names."""

    def __init__(self, names: list[str], weights: dict[tuple[str, str], np.ndarray]):
        self.names = sorted(names)
        self.pairs = [(a, b) for i, a in enumerate(self.names) for b in self.names[i + 1:]]
        self.w = np.array([weights[p] for p in self.pairs], np.float32).reshape(len(self.pairs), DIMS + 1)

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the winner, its confidence) for every row."""
        votes, sums = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        least = np.full((len(x), len(self.names)), np.inf)
        margins = x @ self.w[:, :-1].T + self.w[:, -1]
        for (a, b), m in zip(self.pairs, margins.T):
            for name, side in ((a, m), (b, -m)):
                i = self.names.index(name)
                votes[:, i] += (side > 0) | ((side == 0) & (name == a))
                sums[:, i] += side
                least[:, i] = np.minimum(least[:, i], side)
        best = np.lexsort((np.broadcast_to(-np.arange(len(self.names)), votes.shape), sums, votes), axis=1)[:, -1]
        return best, 1 / (1 + np.exp(-4 * np.minimum(np.take_along_axis(least, best[:, None], 1)[:, 0], 8)))


class Model:
    """Families, and the languages of each."""

    def __init__(self, langs: list[str], weights: dict[tuple[str, str, str], np.ndarray]):
        families: dict[str, list[str]] = {}
        for lang in langs:
            families.setdefault(family(lang), []).append(lang)
        of = lambda scope: {(a, b): w for (s, a, b), w in weights.items() if s == scope}
        self.first = Machines(list(families), of("*")) if families else None
        self.then = {f: Machines(some, of(f)) for f, some in families.items()}

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = column.to_pylist()
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if self.first is None:
            return lang, score
        x = vectors(column)
        known = np.array([has_letter(t) for t in texts], bool)
        fam, sure = self.first.decide(x)
        for i, f in enumerate(self.first.names):
            rows = np.flatnonzero(known & (fam == i))
            if rows.size:
                best, inner = self.then[f].decide(x[rows])
                score[rows] = sure[rows] * inner
                for r, k in zip(rows.tolist(), best.tolist()):
                    lang[r] = self.then[f].names[k]
        return lang, score


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, seed: int = 11) -> Model:
    """Train on rows of texts and non-null languages."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "text"))
    # distinct hashes are ranked before any text moves; of a language only those that can be among the first, whose number doesn't grow
    keys = publish(rows.select("lang", "key").distinct(), "language-keys")
    number = keys.groupBy("lang").agg(F.count("*").alias("n"))
    place = F.shiftrightunsigned("key", 1).cast("double") / float(1 << 63)
    # keys are as good as random: of 4 per_lang + 100 expected ones fewer than per_lang are as good as impossible
    able = keys.join(number, "lang").where(place * F.col("n") <= 4.0 * per_lang + 100)
    # in the order of ``place``, which shares its sign-free bits with the key
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned("key", 1), "key")
    chosen = able.select("lang", "key", F.row_number().over(order).alias("nth")).where(F.col("nth") <= per_lang)
    chosen = publish(chosen, "language-sample")
    langs = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not langs:
        return Model([], {})
    # at most per_lang rows a language are sent
    sample = rows.join(F.broadcast(chosen), ["lang", "key"]).groupBy("lang", "key", "nth").agg(F.min("text").alias("text"))
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(family(lang), []).append(lang)
    tasks = [("*", a, b, lang, side, max(1, PER_FAMILY // len(members[f]))) for i, a in enumerate(sorted(members)) for b in sorted(members)[i + 1:]
             for f, side in ((a, 1), (b, -1)) for lang in members[f]]
    tasks += [(f, a, b, lang, side, per_lang) for f, some in members.items() for i, a in enumerate(some) for b in some[i + 1:] for lang, side in ((a, 1), (b, -1))]
    if not tasks:
        return Model(langs, {})
    # one row per machine and language: as many as pairs of languages
    plan = labelled.sparkSession.createDataFrame(tasks, "scope string, a string, b string, t_lang string, side int, most int")
    dealt = sample.join(F.broadcast(plan), (F.col("lang") == F.col("t_lang")) & (F.col("nth") <= F.col("most"))).select("scope", "a", "b", "side", "key", "text")

    def fit(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values(["side", "key", "text"])
        w = train(vectors(pa.array(some["text"], pa.string())), some["side"].to_numpy())
        return pd.DataFrame({"scope": [key[0]], "a": [key[1]], "b": [key[2]], "w": [w.tobytes()]})

    fitted = dealt.groupBy("scope", "a", "b").applyInPandas(fit, "scope string, a string, b string, w binary").collect()
    weights = {(r.scope, r.a, r.b): np.frombuffer(r.w, np.float32) for r in fitted}
    return Model(langs, weights)


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``lang_pred`` and ``score`` of every document."""
    d = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    names = [*d.columns[1:], "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                for at in range(0, part.num_rows, 1000):
                    some = part.slice(at, 1000)
                    lang, score = model.predict(some.column(0))
                    yield pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=names)

    kinds = ", ".join(f"{c} {t}" for c, t in d.dtypes[1:])
    return d.mapInArrow(lambda b: released(run(b)), f"{kinds}, lang_pred string, score double").withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the documents that aren't held out, and predict all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
