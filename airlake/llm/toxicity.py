"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns the words of a clause into classes: insult, harm, will, target, negation, report, other.  Four
sequential transducers are composed with it: threats (will before harm), negation, targets (who is meant, before or after) and reported
speech.  Each rewrites symbols of its input and sees what stood before; their composition is one machine, whose output
says what every insult or threat of the clause is: bare, directed, negated or reported.  Clauses are scored by what they match, and
a document by the weights of its matches.

Words of the grammar are fixed lists.  Insults are learned: a word, or a stem that words begin with, is one if it stands in far more
different contexts (word before, word after) of toxic than of other texts, so that copies, repeated passages and frequent words prove
nothing.  Stems are learned from a bounded sample, about ``PER_LABEL`` distinct texts a label, picked by a keyed hash of the text, and no more than
``MOST_STEMS`` are kept (and as many words that begin so and still are usual); the weights of the machine's outputs are a logistic regression with priors on all labelled documents, which Spark counts by what they
match (four levels of seven outputs).  Scoring covers every whole text and reads nothing but the text.

Defined cases: a null or empty text matches nothing and has the score of such texts; a null id is never labelled; several labels of an
id count as the highest, null labels as none; repeated rows are scored each; with no labels the priors decide; an empty table gives an empty
result; texts of any length are read whole, clause by clause, and one without separators is one clause.  Only the named columns are
read, so others can't clash.  Insults inside words (scripts without spaces) aren't found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm.common import publish, slices, table
from airlake.llm.registry import query

PER_LABEL, MOST_STEMS = 5_000, 5_000
#: An insult has so many different contexts in toxic texts at least, and that many times its share of others'.
LEAST_CONTEXTS, LEAST_RATIO, CHANCE = 8, 20.0, 0.01
SHORTEST, LONGEST = 3, 12
#: How many words on a negation reaches, and a will.
REACH, AHEAD = 3, 4
#: Matches of one kind count up to so many.
LEVELS = 3

# Words of the grammar.
NEGATIONS = "not no never neither nor without kein keine keinen nicht nie niemals ohne ne pas jamais aucun sans nunca jamás sin ningún".split()
REPORTS = ("said says called calls wrote writes quoted quote reported claimed sagte sagt schrieb nannte zitierte behauptete "
           "disait appelé écrit cité dijo dice llamó escribió citó").split()
TARGETS = "you your yours he she him her they them du dich dir dein deine ihr euch sie tu toi te ton ta vous votre tú tus usted ustedes vosotros él ella".split()
WILLS = "will shall gonna going want wanna should must werde werden will wollen soll vais va allons veux dois voy vamos quiero deberías".split()
HARMS = "kill hurt destroy beat burn shoot stab strangle die töten umbringen schlagen verbrennen vernichten sterben tuer frapper brûler détruire mourir matar golpear quemar destruir morir".split()

#: Classes of words, and what they become: outputs that count come first.
OTHER, INSULT, HARM, WILL, TARGET, NEGATION, REPORT = "OIHWTNR"
#: bare insult, directed, negated, reported; threat, negated, reported
KINDS = "IDirVvq"
#: What the weights lean to, in log odds: of any match, what the kinds but the first add to it, and of texts as such.  A kind that no label speaks
#: about so follows the others.
PRIOR = np.array([2.0, 0.5, -2.0, -1.5, 0.5, -2.0, -1.5, -3.0])
_WORD = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"[^.!?;:,\n…。！？；，、]+")


class Transducer(NamedTuple):
    """A sequential transducer: for every state, input symbol to (next state, output symbol).  State 0 is the first; all accept."""

    arcs: list[dict[str, tuple[int, str]]]

    def __call__(self, symbols: str) -> str:
        state, out = 0, []
        for s in symbols:
            state, o = self.arcs[state][s]
            out.append(o)
        return "".join(out)


def machine(alphabet: str, first, step: Callable) -> Transducer:
    """The transducer of ``step(state, symbol) -> (state, symbol)``, by walking all states that can be reached."""
    names, arcs = {first: 0}, []
    queue = [first]
    for state in queue:
        row = {}
        for s in alphabet:
            to, out = step(state, s)
            if to not in names:
                names[to] = len(names)
                queue.append(to)
            row[s] = (names[to], out)
        arcs.append(row)
    return Transducer(arcs)


def compose(f: Transducer, g: Transducer) -> Transducer:
    """First ``f``, then ``g`` on its output, as one machine."""

    def step(state: tuple[int, int], s: str) -> tuple[tuple[int, int], str]:
        a, middle = f.arcs[state[0]][s]
        b, out = g.arcs[state[1]][middle]
        return (a, b), out

    return machine("".join(f.arcs[0]), (0, 0), step)


def threats() -> Transducer:
    """A harm within ``AHEAD`` words of a will is a threat; another is a word like others."""

    def step(left: int, s: str) -> tuple[int, str]:
        if s == WILL:
            return AHEAD, s
        return max(0, left - 1), ("V" if left else OTHER) if s == HARM else s

    return machine("OIHWTNR", 0, step)


def negation() -> Transducer:
    """Insults and threats within ``REACH`` words of a negation are denied."""

    def step(left: int, s: str) -> tuple[int, str]:
        if s == NEGATION:
            return REACH, s
        return max(0, left - 1), {"I": "i", "V": "v"}.get(s, s) if left else s

    return machine("OIVWTNR", 0, step)


def targets() -> Transducer:
    """An insult after a target is directed, and a target after an insult directs it."""

    def step(seen: str, s: str) -> tuple[str, str]:
        if s == TARGET:
            return "target", "D" if seen == "insult" else s
        if s == INSULT:
            return ("target", "D") if seen == "target" else ("insult", s)
        return seen, s

    return machine("OIiVvWTNR", "", step)


def reports() -> Transducer:
    """What follows a report in its clause is another's word."""

    def step(quoted: bool, s: str) -> tuple[bool, str]:
        return quoted or s == REPORT, {"I": "r", "D": "r", "V": "q"}.get(s, s) if quoted else s

    return machine("OIDiVvWTNR", False, step)


def grammar() -> Transducer:
    """All four as one machine over classes of words."""
    return compose(compose(compose(threats(), negation()), targets()), reports())


class Lexicon:
    """The lexical transducer: word to class.

    Learned insults end in ``$`` if they are whole words, else any word may begin so, but for words that end in ``!``.
    """

    MOST = 100_000

    def __init__(self, stems: list[str]):
        self.whole = {s[:-1] for s in stems if s.endswith("$")}
        self.clean = {s[:-1] for s in stems if s.endswith("!")}
        self.stems = {s for s in stems if s[-1] not in "$!"}
        self.sizes = sorted({len(s) for s in self.stems})
        self.fixed = {w: c for c, some in ((HARM, HARMS), (WILL, WILLS), (TARGET, TARGETS), (REPORT, REPORTS), (NEGATION, NEGATIONS)) for w in some}
        self.known: dict[str, str] = {}

    def of(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            insult = word in self.whole or word not in self.clean and any(word[:k] in self.stems for k in self.sizes if k <= len(word))
            found = INSULT if insult else self.fixed.get(word, OTHER)
            if len(word) <= 64:
                if len(self.known) >= self.MOST:
                    self.known.clear()
                self.known[word] = found
        return found


def matches(text: str | None, lexicon: Lexicon, found: Transducer) -> list[tuple[int, int, str]]:
    """(start, end, outputs) of every clause that matches, in code points; outputs are its kinds in order."""
    if not text:
        return []
    classes = {lexicon.of(w) for w in set(map(str.lower, _WORD.findall(text)))}
    if INSULT not in classes and not {HARM, WILL} <= classes:
        return []
    out = []
    for clause in _CLAUSE.finditer(text):
        state, kinds = 0, []
        for m in _WORD.finditer(text, clause.start(), clause.end()):
            state, symbol = found.arcs[state][lexicon.of(m[0].lower())]
            if symbol in KINDS:
                kinds.append(symbol)
        if kinds:
            out.append((clause.start(), clause.end(), "".join(kinds)))
    return out


def clauses(docs: DataFrame, stems: list[str], text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``counts`` (matches of every kind) and ``clauses`` (start, end, kinds of every matched clause) of every row."""
    d = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    names = [*d.columns[1:], "counts", "clauses"]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kinds", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, found = Lexicon(stems), grammar()
        for batch in batches:
            for part in slices(batch, 0):
                some = [matches(t, lexicon, found) for t in part.column(0).to_pylist()]
                counts = [[sum(k.count(x) for _, _, k in m) for x in KINDS] for m in some]
                told = [[{"start": a, "end": b, "kinds": k} for a, b, k in m] for m in some]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(counts, pa.list_(pa.int32())), pa.array(told, kind)], names=names)

    own = ", ".join(f"{c} {t}" for c, t in d.dtypes[1:])
    return d.mapInArrow(run, (own + ", " if own else "") + "counts array<int>, clauses array<struct<start: long, end: long, kinds: string>>").withColumnsRenamed(
        {f"_{i}": c for i, c in enumerate(keep)})


def contexts(sample: DataFrame) -> DataFrame:
    """(word, toxic, other): how many different contexts every word of (text, toxic) rows has in texts of either label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 1 << 20):
                seen: set[tuple[str, int, int]] = set()
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = ["", *(x.lower() for x in _WORD.findall(text)), ""]
                    seen.update((b, zlib.crc32(f"{a} {c}".encode()), label) for a, b, c in zip(w, w[1:], w[2:]))
                word, context, label = zip(*seen) if seen else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(context, pa.int64()), pa.array(label, pa.int32())], names=["word", "context", "label"])

    each = sample.select("text", "toxic").mapInArrow(run, "word string, context long, label int")
    each = each.groupBy("word", "context").agg(F.max("label").alias("t"), F.min("label").alias("o"))
    return each.groupBy("word").agg(F.sum("t").cast("double").alias("toxic"), F.sum(1 - F.col("o")).cast("double").alias("other"))


def learn_stems(sample: DataFrame, chance: float = CHANCE) -> list[str]:
    """Words (``$`` at the end) and stems that tell toxic texts, and words with such a stem that don't (``!``), from (text, toxic) rows."""
    words = publish(contexts(sample), "toxicity-words")
    all_t, all_o = words.agg(F.sum("toxic"), F.sum("other")).first()
    if not all_t or not all_o:
        return []
    upto = F.least(F.length("word"), F.lit(LONGEST))
    begins = F.when(upto >= SHORTEST, F.transform(F.sequence(F.lit(SHORTEST), upto), lambda k: F.substring(F.col("word"), F.lit(1), k))).otherwise(F.array())
    stems = words.select(F.explode(F.concat(begins, F.array(F.concat("word", F.lit("$"))))).alias("stem"), "toxic", "other")
    stems = stems.groupBy("stem").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o"))
    # a test per stem that there is; the likelihood ratio of "the same share in both"
    tests = max(1, words.count() * (LONGEST - SHORTEST + 2))
    t, o = F.col("t"), F.col("o")
    share = (t + o) / (all_t + all_o)
    part = lambda x, whole: F.when(x > 0, x * F.log(x / (whole * share))).otherwise(0.0)
    rest = lambda x, whole: F.when(x < whole, (whole - x) * F.log((whole - x) / (whole * (1 - share)))).otherwise(0.0)
    g = 2 * (part(t, all_t) + rest(t, all_t) + part(o, all_o) + rest(o, all_o))
    ratio = lambda t, o: ((t + 0.5) / (all_t + 1)) / ((o + 0.5) / (all_o + 1))
    told = stems.where((t >= LEAST_CONTEXTS) & (ratio(t, o) >= LEAST_RATIO)).select("stem", g.alias("g")).where(F.col("g") > float(2 * np.log(tests / chance)))
    best = told.orderBy(F.desc("g"), F.desc(F.length("stem")), "stem").limit(MOST_STEMS).collect()
    # of stems that begin with one another the strongest stays, the longer among equals
    kept: set[str] = set()
    begun: set[str] = set()
    for r in best:
        own = [r.stem[:k] for k in range(SHORTEST, len(r.stem) + 1)]
        if r.stem not in begun and kept.isdisjoint(own):
            kept.add(r.stem)
            begun.update(own)
    # words of those stems that other texts use as well
    own = words.sparkSession.createDataFrame([(s,) for s in sorted(kept) if s[-1] != "$"], "stem string")
    usual = words.where((F.col("other") >= 2) & (ratio(F.col("toxic"), F.col("other")) < LEAST_RATIO))
    usual = usual.select("word", "other", F.explode(begins).alias("stem")).join(own, "stem").select("word", "other").distinct()
    return sorted(kept) + [f"{r.word}!" for r in usual.orderBy(F.desc("other"), "word").limit(MOST_STEMS).collect()]


def learn_weights(counted: DataFrame, ridge: float = 1.0) -> np.ndarray:
    """The weights (see ``PRIOR``) from (counts, toxic) rows; Spark counts equal rows."""
    level = F.transform("counts", lambda c: F.least(c, F.lit(LEVELS)))
    rows = counted.groupBy(level.alias("x")).agg(F.count("*").alias("n"), F.sum("toxic").alias("y")).collect()
    w = PRIOR.copy()
    if not rows:
        return w
    rows = sorted(rows, key=lambda r: r.x)
    x = np.array([[min(sum(r.x), LEVELS), *r.x[1:], 1.0] for r in rows], float)
    n, y = np.array([float(r.n) for r in rows]), np.array([float(r.y) for r in rows])
    # Newton's steps, the longer ones cut: a convex problem
    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (y - n * p) - ridge * (w - PRIOR)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-10:
            break
    return w


class Model(NamedTuple):
    stems: list[str]
    weights: np.ndarray


def labelled(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(l_id, toxic): one row per id, 1 if any of its labels is."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
    return rows.groupBy(F.col(id_col).cast("long").alias("l_id")).agg(F.max(label_col).cast("int").alias("toxic"))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_label: int, seed: int) -> DataFrame:
    """(text, toxic): about ``per_label`` distinct texts of either label, all if there are fewer."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.lit(seed), F.col(text_col)).alias("key")).where(F.col("text").isNotNull())
    keys = publish(keyed.select("id", "key").join(labels, F.col("id") == F.col("l_id")).select("key", "toxic").distinct(), "toxicity-keys")
    number = {r.toxic: r["count"] for r in keys.groupBy("toxic").count().collect()}
    picked = F.lit(False)
    for label, n in number.items():
        picked = picked | ((F.col("toxic") == label) & (F.pmod("key", F.lit(1 << 31)) < int(min(1.0, per_label / n) * (1 << 31))))
    # about twice per_label rows of two numbers
    chosen = F.broadcast(keys.where(picked).withColumnRenamed("key", "c_key"))
    return keyed.join(chosen, F.col("key") == F.col("c_key")).groupBy("key", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def score(weights: np.ndarray, counts: str = "counts") -> Column:
    """Chance of label 1, from the matches."""
    each = [F.least(F.element_at(counts, i + 1), F.lit(LEVELS)) for i in range(len(KINDS))]
    total = F.lit(float(weights[-1])) + F.least(sum(each[1:], each[0]), F.lit(LEVELS)) * float(weights[0])
    for x, w in zip(each[1:], weights[1:-1]):
        total = total + x * float(w)
    return 1 / (1 + F.exp(-total))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, seed: int = 5) -> tuple[DataFrame, Model]:
    """((doc_id, score, predicted, clauses) of all documents, the model) learned from ``labels`` (l_id, toxic)."""
    stems = learn_stems(_sample(docs, labels, id_col, text_col, per_label, seed))
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    told = publish(clauses(told, stems), "toxicity-clauses")
    model = Model(stems, learn_weights(told.select("doc_id", "counts").join(labels, F.col("doc_id") == F.col("l_id"))))
    scored = told.select("doc_id", score(model.weights).alias("score"), "clauses")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses"), model


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; learn from the labels that aren't held out."""
    labels = labelled(table(spark, sf_dir, "labels")).where(~held_out("l_id"))
    found, _ = assess(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("clauses").cast("long").alias("n_clauses"))
