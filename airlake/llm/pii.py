"""Personal data: patterns, and terms that give the protected values away.

*Patterns.*  E-mail addresses, IP addresses, card numbers and telephone numbers.  Their values are the protected entities.

*Disclosure.*  A term that keeps company with an entity tells of it even when the entity itself is masked.  All four counts are of distinct
texts over the whole corpus, so copies change nothing: ``n_e`` those that hold the entity, ``n_te`` those that hold the term in a context of
the entity (the ``WINDOW`` words on either side, however far they reach), ``n_t`` those that hold the term, N all.  The pointwise mutual
information of term and entity as a share of the entity's own information content,

    log2(n_te N / (n_t n_e)) / log2(N / n_e),

is 1 for a term found with the entity only.  From ``GENERALISE`` on, a term is generalised in documents that hold the entity, and
from ``REMOVE`` on removed.  Terms need ``SUPPORT`` distinct contexts with the entity, so nothing is concluded from
a single mention or from one passage that was copied into many texts.

Sanitised text has ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]`` for entities, ``[TERM]`` for generalised terms and nothing for removed ones.

Defined cases: a null text counts as empty; added spans never touch a pattern's; repeated rows are documents of their
own but one text; an empty table gives an empty result.  Only the id, the text and the columns to keep are read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlake.llm.common import publish, slices, table
from airlake.llm.registry import query
from airlake.llm.spans import apart, joined, replaced

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalise", "remove")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}
WINDOW, SUPPORT = 5, 3
GENERALISE, REMOVE = 0.8, 0.95
SHORTEST = 3
#: Copied texts up to this number are taken out by their hashes; with more, all texts are reduced to distinct ones.
SENT_COPIES = 500_000
#: Candidate terms up to this number are looked for directly; more are counted with all words.
SENT_TERMS = 200_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins with a whole run of digits, as the last part takes its run whole.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_FULL = re.compile(r"\S+")
_NO_DIGIT = re.compile(r"[^0-9]+")
_BREAK = str.maketrans({c: " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"})


def luhn(digits: str) -> bool:
    n = [int(d) for d in reversed(digits)]
    return (sum(n[::2]) + sum(sum(divmod(2 * d, 10)) for d in n[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from the ``@`` outwards, so that long words cost no more than their length."""
    upto = 0
    for m in _DOMAIN.finditer(text):
        a = m.start()
        while a > upto and text[a - 1] in _LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            upto = m.end()


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost, non-overlapping in each kind; failing matches are dropped."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NO_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


def entity(text: str, span: tuple[int, int, str]) -> int:
    """A number for the protected value, whatever its spelling."""
    a, b, kind = span
    value = text[a:b].lower() if kind in ("email", "ip") else _NO_DIGIT.sub("", text[a:b])
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "big", signed=True)


def terms(text: str) -> list[str]:
    """Words that can tell: without punctuation, in lower case, long enough, not numbers."""
    return [w for w in text.lower().translate(_BREAK).split() if len(w) >= SHORTEST and not w.isdigit()]


def contexts(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """(entity, context, term) for the words around every protected value; the term is None where no word can tell."""
    hidden = list(text)
    for a, b, _ in base:
        hidden[a:b] = " " * (b - a)
    blank = "".join(hidden)
    # words never cross a value, as it is blank; values between the same two words have one context
    start, end, known = [], [], {}
    for m in _FULL.finditer(blank):
        start.append(m.start())
        end.append(m.end())
    for a, b, kind in base:
        upto, after = bisect_right(end, a), bisect_left(start, b)
        if (upto, after) not in known:
            near = [*range(max(0, upto - WINDOW), upto), *range(after, min(after + WINDOW, len(start)))]
            around = terms(" ".join(blank[start[i]:end[i]] for i in near))
            known[upto, after] = int.from_bytes(hashlib.blake2b(" ".join(around).encode(), digest_size=8).digest(), "big", signed=True), set(around) or {None}
        mark, told = known[upto, after]
        for t in told:
            yield entity(text, (a, b, kind)), mark, t


def _same(text_col: str) -> Column:
    """Equal for equal texts; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def find_patterns(docs: DataFrame, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """Kept columns, the hash of the text, the text where it holds a protected value (else null), its spans, and the contexts as arrays."""
    d = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], _same(text_col).alias("same"))
    names = [*d.columns[1:], "held", "starts", "ends", "kinds", "entity", "context", "term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                held, spans, around = [], [], []
                for text in part.column(0).to_pylist():
                    base = pattern_spans(text) if text else []
                    held.append(text if base else None)
                    spans.append(sorted(base, key=lambda s: (s[0], KINDS.index(s[2]))))
                    around.append(list(contexts(text, base)) if base else [])
                columns = [pa.array(held, pa.string())]
                columns += [pa.array([[s[i] for s in some] for some in spans], pa.list_(t)) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
                columns += [pa.array([[c[i] for c in some] for some in around], pa.list_(t)) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *columns], names=names)

    own = ", ".join(f"{c} {t}" for c, t in d.dtypes[1:])
    return d.mapInArrow(run, (own + ", " if own else "") + "held string, starts array<int>, ends array<int>, kinds array<string>, entity array<long>, context array<long>, term array<string>")


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Every text once.  As a rule only texts that are there more than once move."""
    d = docs.select(F.col(text_col).cast("string").alias("text"), _same(text_col).alias("same"))
    copied = publish(d.groupBy("same").agg(F.count("*").alias("n")).where("n > 1").select("same"), "pii-copied")
    if copied.count() > SENT_COPIES:
        return d.dropDuplicates(["same"]).select("text")
    return d.join(copied, "same", "left_anti").unionByName(d.join(copied, "same", "left_semi").dropDuplicates(["same"])).select("text")


def document_counts(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(term, n_t): in how many distinct texts each wanted term is."""
    few = wanted.limit(SENT_TERMS + 1).collect()
    known = frozenset(r.term for r in few) if len(few) <= SENT_TERMS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            seen.clear()
            return out

        for batch in batches:
            for part in slices(batch, 0):
                for text in part.column(0).to_pylist():
                    if text:
                        words = set(text.lower().translate(_BREAK).split())
                        seen.update(words & known if known is not None else words)
                if len(seen) > 300_000:
                    yield rows()
        yield rows()

    if known is not None and not known:
        return wanted.select("term", F.lit(0).cast("long").alias("n_t"))
    counted = distinct_texts(docs, text_col).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    return counted.join(wanted, "term", "left_semi")


def disclosing(found: DataFrame, docs: DataFrame, text_col: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, kind): the terms that give an entity away, over the whole corpus."""
    around = F.explode(F.arrays_zip("entity", "context", "term")).alias("c")
    rows = found.where("held is not null").select("same", around).select("same", "c.entity", "c.context", "c.term").distinct()
    rows = publish(rows, "pii-contexts")
    together = rows.where("term is not null").groupBy("entity", "term").agg(F.countDistinct("same").alias("n_te"), F.countDistinct("context").alias("n_c"))
    together = publish(together.where(F.col("n_c") >= support).drop("n_c"), "pii-together")
    alone = rows.select("entity", "same").distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    n_t = document_counts(docs, together.select("term").distinct(), text_col)
    total = float(found.select("same").distinct().count())
    share = F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e"))) / F.log2(total / F.col("n_e"))
    # an entity known to every text has no information to give
    told = together.join(alone, "entity").join(n_t, "term").where(F.col("n_e") < total).withColumn("share", share).where(F.col("share") >= generalise)
    return publish(told.select("entity", "term", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("kind")), "pii-terms")


def sanitise(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), **limits: float) -> DataFrame:
    """The columns ``keep`` and n_email, n_ip, n_card, n_phone, base, spans, and ``sanitised`` where it differs from the text (else null)."""
    found = find_patterns(docs, text_col, keep)
    found = publish(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    own = found.columns[:len(keep)]
    held = found.where("held is not null").select("row", *own, "held", "starts", "ends", "kinds")
    words = found.where("held is not null").select("row", F.explode(F.array_distinct("entity")).alias("entity"))
    told = words.join(disclosing(found, docs, text_col, **limits), "entity").groupBy("row", "term").agg(F.max("kind").alias("kind"))  # remove is the larger
    told = told.groupBy("row").agg(F.collect_list("term").alias("terms"), F.collect_list("kind").alias("levels"))
    names = [*own, *[f"n_{k}" for k in BASE], "base", "spans", "sanitised"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, bases, all_spans, texts = [], [], [], []
            for r in batch.select(["held", "starts", "ends", "kinds", "terms", "levels"]).to_pylist():
                text, base = r["held"], list(zip(r["starts"], r["ends"], r["kinds"]))
                level = dict(zip(r["terms"] or [], r["levels"] or []))
                more = []
                if level:
                    pattern = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(level, key=len, reverse=True))) + r")(?![^\W_])", re.IGNORECASE)
                    more = [(m.start(), m.end(), level[m[0].lower()]) for m in pattern.finditer(text) if m[0].lower() in level]
                spans = base + apart(more, base)
                counts.append([sum(s[2] == k for s in base) for k in BASE])
                bases.append(joined(base, KINDS))
                all_spans.append(joined(spans, KINDS))
                texts.append(replaced(text, spans, MARKS))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], *[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)],
                 *[pa.array(x, pa.string()) for x in (bases, all_spans, texts)]], names=names)

    kinds = ", ".join([*[f"{c} {t}" for c, t in found.select(*own).dtypes], *[f"n_{k} long" for k in BASE], "base string, spans string, sanitised string"])
    marked = held.join(told, "row", "left").mapInArrow(run, kinds)
    plain = found.where("held is null").select(*own, *[F.lit(0).cast("long").alias(f"n_{k}") for k in BASE], F.lit("").alias("base"), F.lit("").alias("spans"),
                                               F.lit(None).cast("string").alias("sanitised"))
    return marked.unionByName(plain).withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms that give it away."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sanitise(docs).select("doc_id", *[f"n_{k}" for k in BASE], F.sha2("base", 256).alias("base_sha256"), "spans")
