"""Jaccard join of documents on word n-grams by vertical partitioning.

The n-grams of the corpus have one global order, that of their 64-bit hashes.  The order is cut into fragments, so
every document's set falls into segments.

*Candidates.*  Two sets of at most r n-grams that reach the similarity differ in at most ``t = 2 r (1 - s) / (1 + s)``
n-grams, so of t + 1 fragments one holds equal segments.  A document sends one signature per segment, for its
own class of sizes and for the next one, so that the sizes of any linked pair meet.  A segment mixes rare and common
n-grams, therefore passages that many documents share make no common signature.  Empty segments count only where
a document has more of them than the spare fragments absorb.

*Overlaps.*  For candidate pairs the n-grams in common are counted per fragment and the partial counts are summed
per pair; the sum decides exactly.

*Groups of copies.*  Equal sets are one node, wherever they are.  The n-grams that a node shares with no other candidate bound
its overlap with all of them; nodes that can reach no partner leave.  A parity sketch of ``SKETCH`` bits bounds from below
by how many n-grams two sets differ.  In a signature's group every node is then paired
with one pivot only, the set with the fewest n-grams of its own.  Linked pairs are contracted to components, and the pairs within a
signature that still lie in different components, and whose bounds allow a link, follow in a second turn: a group of
n near copies costs about n pairs, and no link between components is lost.

Defined cases: a null or wordless text has an empty set and links with nothing; fewer words than n make one n-gram;
a null id is a document like others but never names a component unless all its ids are null; repeated ids and
rows are separate documents; a text of any length is one set, made in one piece; an empty table gives an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlake.llm.common import discard, publish, published, slices, table, utf8
from airlake.llm.registry import query
from airlake.llm.shingles import U, mix64, shingle_sets

#: Bits of a set's sketch: the parity of the n-grams that fall on each.
SKETCH = 1024
#: Bytes of text that a task works on at a time: its arrays take some fifty times as much.
SLICE = 1 << 20
#: Sides of joins up to this many rows of at most four numbers are sent to all tasks (64 MB).
SENT_ROWS = 500_000


#: Parts of the fragments that are counted one after the other.
TURNS = 2


class Sizes:
    """Classes of set sizes and their numbers of fragments for a similarity of ``percent`` / 100."""

    def __init__(self, percent: int, largest: int):
        self.last = [0]  # last size of every class; class 0 holds the empty set
        while self.last[-1] < largest or len(self.last) < 3:
            self.last.append(max(self.last[-1] + 1, (self.last[-1] + 1) * 100 // percent))
        self.last.append(max(self.last[-1] + 1, (self.last[-1] + 1) * 100 // percent))
        last = np.array(self.last, np.int64)
        differ = 2 * last * (100 - percent) // (100 + percent)
        self.spare = np.where(differ > 0, 1 + differ // 32, 0)
        self.fragments = differ + 1 + self.spare

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(self.last), size, "left")


def signatures(size: np.ndarray, sets: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of the segments of all sets, without those of empty sets."""
    rows = len(size)
    if not len(sets):
        return np.zeros(0, np.int64), np.zeros(0, U)
    classes = Sizes(percent, int(size.max()))
    own = classes.of(size)
    of = np.repeat(np.arange(rows), size)
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix64(sets + U(0x51)), dtype=U)))
    out = []
    for up in (0, 1):
        tag = own + up
        count = classes.fragments[tag]
        part = ((sets >> U(32)) * count[of].astype(U)) >> U(32)
        new = np.ones(len(sets) + 1, bool)
        new[1:-1] = (part[1:] != part[:-1]) | (of[1:] != of[:-1])
        edge = np.flatnonzero(new)
        row, piece = of[edge[:-1]], part[edge[:-1]]
        sig = mix64((total[edge[1:]] - total[edge[:-1]]) * U(0x9FB21C651E98DF25) + tag[row].astype(U) * U(0xD6E8FEB86659FD93) + piece)
        out.append((row, sig))
        empty = np.where(size > 0, count - np.bincount(row, minlength=rows), 0)
        for r in np.flatnonzero(empty > classes.spare[tag]).tolist():
            gone = np.setdiff1d(np.arange(count[r], dtype=U), piece[row == r])
            out.append((np.full(len(gone), r), mix64(gone + U(int(tag[r]) * 0xA0761D6478BD642F % (1 << 64)))))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def node_ids(size: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """One number per set; equal sets have equal numbers."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix64(sets), dtype=U)))
    cut = np.concatenate(([0], np.cumsum(size)))
    return mix64((total[cut[1:]] - total[cut[:-1]]) + size.astype(U) * U(0xE7037ED1A0B428DB)).view(np.int64)


def document_nodes(docs: DataFrame, n: int, id_col: str, text_col: str, keep: tuple[str, ...] = (), first: bool = False) -> DataFrame:
    """(doc_id, node, n_shingles) and the columns ``keep`` for every document.

    With ``first``, a row is left out where its partition has shown the same set with an id that is as small: what a choice of the
    smallest id can't take, so large groups of copies shrink before any shuffle.
    """
    d = docs.select(F.col(text_col).cast("string").alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)])
    names = [*d.columns[1:], "node", "n_shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, float] = {}
        for batch in batches:
            for some in slices(batch, 0, SLICE):
                size, sets = shingle_sets(*utf8(some.column(0)), n)
                node = node_ids(size, sets)
                out = pa.RecordBatch.from_arrays([*some.columns[1:], pa.array(node), pa.array(size)], names=names)
                if first:
                    new = size == 0
                    for i, (x, doc) in enumerate(zip(node.tolist(), some.column(1).to_pylist())):
                        doc = float("inf") if doc is None else doc
                        if x not in least or doc < least[x]:
                            least[x], new[i] = doc, True
                    out = out.filter(pa.array(new))
                yield out

    kinds = ", ".join(f"{c} {t}" for c, t in d.dtypes[1:])
    return d.mapInArrow(run, f"{kinds}, node long, n_shingles long").withColumnsRenamed({f"_{i}": c for i, c in enumerate(keep)})


def _signature_rows(docs: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """(sig, node, n_shingles): one row per segment of every set, once for equal sets of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for some in slices(batch, 0, SLICE):
                size, sets = shingle_sets(*utf8(some.column(0)), n)
                node = node_ids(size, sets)
                row, sig = signatures(size, sets, percent)
                fresh = np.zeros(len(size), bool)
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                use = fresh[row]
                row = row[use]
                for a in range(0, len(row), 1 << 18):
                    r = row[a:a + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(sig[use][a:a + (1 << 18)].view(np.int64)), pa.array(node[r]), pa.array(size[r].astype(np.int32))],
                                                     names=["sig", "node", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "sig long, node long, n int")


def _segments(docs: DataFrame, wanted: DataFrame, owners: DataFrame, n: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """(node, n, fragment, grams, sketch) of the wanted nodes, from one document of each; the sketch is in the node's first row only.

    And the path that they are read from.
    """
    reps = owners.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("rep"))
    reps = publish(reps.select("rep").distinct(), "jaccard-reps", clean=True)
    if reps.count() <= SENT_ROWS:
        reps = F.broadcast(reps)
    some = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    some = some.join(reps, F.col("_id").eqNullSafe(F.col("rep")), "left_semi").select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                size, sets = shingle_sets(*utf8(part.column(0)), n)
                node = node_ids(size, sets)
                of = np.repeat(np.arange(len(size)), size)
                piece = (sets >> U(61)).astype(np.int64)
                new = np.ones(len(sets) + 1, bool)
                new[1:-1] = (piece[1:] != piece[:-1]) | (of[1:] != of[:-1])
                edge = np.flatnonzero(new) if len(sets) else np.zeros(1, np.int64)
                grams = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(sets.view(np.int64)))
                at = edge[:-1]
                bits = np.bincount(of * SKETCH + (sets & U(SKETCH - 1)).astype(np.int64), minlength=len(size) * SKETCH) & 1
                words = np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(size), SKETCH // 64)
                head = np.ones(len(at), bool)
                head[1:] = of[at[1:]] != of[at[:-1]]
                upto = np.concatenate(([0], np.cumsum(head))) * (SKETCH // 64)
                sketch = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(words[of[at[head]]].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(node[of[at]]), pa.array(size[of[at]]), pa.array(piece[at].astype(np.int32)), grams, sketch],
                                                 names=["node", "n", "fragment", "grams", "sketch"])

    rows = some.mapInArrow(run, "node long, n long, fragment int, grams array<long>, sketch array<long>")
    rows, path = published(rows, "jaccard-segments", clean=True)
    # an id that several rows have brings a node's segments several times, or other nodes: where there are such, and only then, segments are shuffled
    seen = rows.groupBy("node").agg(F.count("*").alias("n"), F.countDistinct("fragment").alias("fragments"))
    again = publish(seen.where("n > fragments").select("node"), "jaccard-again", clean=True)
    other = publish(seen.select("node").join(wanted, "node", "left_anti"), "jaccard-other", clean=True)
    if not other.isEmpty():
        rows = rows.join(other, "node", "left_anti")
    if not again.isEmpty():
        rows = rows.join(again, "node", "left_anti").unionByName(rows.join(again, "node", "left_semi").dropDuplicates(["node", "fragment"]))
    return rows, path


def linked(pairs: DataFrame, seg: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity: n-grams in common, counted per fragment and summed."""
    left = seg.select(F.col("node").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("grams").alias("of_a"))
    right = seg.select(F.col("node").alias("b"), F.col("n").alias("n_b"), "fragment", F.col("grams").alias("of_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("of_a", "of_b")).alias("common"))
    total = partial.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), F.sum("common").alias("common"))
    return publish(total.where(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b"), "jaccard-links", clean=True)


def _shared(met: DataFrame, seg: DataFrame, percent: int) -> DataFrame:
    """(sig, node, n, rare) of the rows of ``met`` that can still link, ``rare`` being the node's n-grams that no other node of ``met`` has.

    A node has at most n - rare n-grams in common with any other, and a link with the smallest set of its signature's group needs
    percent / (100 + percent) of both sizes.
    """
    counted = []
    for turn in range(TURNS):
        # fragments are counted apart from each other, so that the n-grams of some of them only are on disk at a time
        grams = seg.where(F.col("fragment") % TURNS == turn).select("node", F.explode("grams").alias("gram"))
        alone = grams.groupBy("gram").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
        counted.append(publish(alone.groupBy("node").agg(F.count("*").alias("rare")), "jaccard-rare", clean=True))
    rare = reduce(DataFrame.unionByName, counted).groupBy("node").agg(F.sum("rare").alias("rare"))
    rows = met.select("sig", "node", "n").join(rare, "node", "left").select("sig", "node", "n", F.coalesce("rare", F.lit(0)).alias("rare"))
    least = met.groupBy("sig").agg(F.min("n").alias("least"))
    able = rows.join(least, "sig").where((F.col("n") - F.col("rare")) * (100 + percent) >= (F.col("n") + F.col("least")) * percent).drop("least")
    groups = able.groupBy("sig").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("sig")
    return publish(able.join(groups, "sig", "left_semi"), "jaccard-able", clean=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): for every node of an edge (a, b), the smallest node of its component.

    Alternates the two star steps: every node hands its larger neighbours, then its smaller ones, to the smallest
    node it knows.  Each step is a minimum with map-side combine and a join; the number of rounds is logarithmic.
    """
    edges = publish(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars", clean=True)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every u > v from here on; each u goes with its smaller neighbours to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = publish(small.distinct(), "stars", clean=True)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def node_links(docs: DataFrame, owners: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(node, comp) of the nodes that link with another node; ``owners`` is (doc_id, node, ..) of all documents."""
    every = Window.partitionBy("sig")
    rows = _signature_rows(docs, n, percent, text_col)
    met = rows.select("sig", "node", "n", F.min("node").over(every).alias("low"), F.max("node").over(every).alias("high")).where("low < high")
    met = publish(met.select("sig", "node", "n").distinct(), "jaccard-met", clean=True)
    seg, path = _segments(docs, met.select("node").distinct(), owners, n, id_col, text_col)
    for _ in range(2):  # what the first turn takes away leaves other nodes with more n-grams of their own
        met = _shared(met, seg, percent)
        before, (seg, path) = path, published(seg.join(met.select("node").distinct(), "node", "left_semi"), "jaccard-segments", clean=True)
        discard(docs.sparkSession, before)

    # what the two sets can have in common at most, against what a link needs
    enough = F.least(F.col("n_a") - F.col("rare_a"), F.col("n_b") - F.col("rare_b")) * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    # bits in which the sketches differ: the sets differ in as many n-grams at least
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    close = differ * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)
    sketched = publish(seg.where(F.size("sketch") > 0).select("node", "sketch"), "jaccard-sketches", clean=True)
    side = lambda x, *more: [F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "rare", *more)]]

    # the pivot of a signature's group is the set with the fewest n-grams of its own: what the others are copies of
    pivot = met.groupBy("sig").agg(F.min(F.struct("rare", "node", "n")).alias("p")).select("sig", "p.*").select("sig", *side("a"))
    stars = met.select("sig", *side("b")).join(pivot, "sig").where("a <> b").where(enough)
    stars = stars.select("a", "b", "n_a", "n_b").distinct()
    for x in ("a", "b"):
        stars = stars.join(sketched.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}")), x)
    stars = publish(stars.where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-stars", clean=True)
    edges = linked(stars, seg, percent)
    comp = components(edges)

    # what a signature still holds in different components: the smaller one's nodes against the larger one's
    placed = met.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = placed.groupBy("sig", "comp").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("rare")).alias("can"), F.count("*").alias("many"))
    several = groups.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig")
    groups = groups.join(several, "sig", "left_semi")
    # only here do the sketches go with the rows: what lies in one component has left
    placed = placed.join(several, "sig", "left_semi").join(sketched, "node")
    one = groups.select("sig", *[F.col(c).alias(f"{c}_1") for c in ("comp", "least", "can", "many")])
    two = groups.select("sig", *[F.col(c).alias(f"{c}_2") for c in ("comp", "least", "can", "many")])
    able = F.least("can_1", "can_2") * (100 + percent) >= (F.col("least_1") + F.col("least_2")) * percent
    first_smaller = (F.col("many_1") < F.col("many_2")) | ((F.col("many_1") == F.col("many_2")) & (F.col("comp_1") < F.col("comp_2")))
    apart = one.join(two, "sig").where(first_smaller & (F.col("comp_1") != F.col("comp_2")) & able).select("sig", "comp_1", "comp_2")
    few = apart.join(placed.select("sig", F.col("comp").alias("comp_1"), *side("a", "sketch")), ["sig", "comp_1"])
    pairs = few.join(placed.select("sig", F.col("comp").alias("comp_2"), *side("b", "sketch")), ["sig", "comp_2"]).where(enough & close)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = linked(publish(pairs, "jaccard-rest", clean=True), seg, percent)
    return components(edges.unionByName(more))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, comp, component_id) of every document.

    Documents with one ``comp`` are reachable by links of at least ``percent`` / 100; ``component_id`` is their smallest id.
    """
    owners = publish(document_nodes(docs, n, id_col, text_col), "jaccard-nodes", clean=True)
    solid = owners.where("n_shingles > 0")
    comp = node_links(docs, solid, n, percent, id_col, text_col)
    placed = publish(solid.join(comp, "node", "left").select("doc_id", "n_shingles", "node", F.coalesce("comp", "node").alias("comp")), "jaccard-placed", clean=True)
    least = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = placed.join(least, "comp").select("doc_id", "n_shingles", "node", "comp", "component_id")
    return out.unionByName(owners.where("n_shingles = 0").select("doc_id", "n_shingles", "node", F.lit(None).cast("long").alias("comp"), F.col("doc_id").alias("component_id")))


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles agree to 85 %."""
    found = near_duplicates(table(spark, sf_dir, "documents"), 4, 85)
    return found.select("doc_id", "n_shingles", "component_id")
