"""Similarity join of word shingle sets by vertical partitioning.

All shingles have one global order: rare ones first, frequent ones last, else by hash. A document's sorted set is cut into
fragments at fixed places of that order. Overlaps are counted in each fragment alone and summed for each pair.

* The order's low end gives the candidates. Two sets that link, the larger one of m shingles, share at least min(`support`, ceil(t m)) of their first
  n - ceil(t n) + `support` shingles: their number is summed for each pair. In the smaller set those are among the first
  n - ceil(2 t n / (1 + t)) + `support`, and the places at which the pair shares them bound what it can share beyond them, as does the
  first place of each set that any other set shares: a pair meets only if sizes and places leave a link possible. Shingles that many sets hold stand at the order's end, so sets that differ from a large group by
  more than a link allows share little with it there.
* Of a candidate pair, whole texts meet, and overlaps are counted in each of FRAGMENTS parts of the hash's range; their sum decides.
* Equal sets are one node from the start. Only shingles that two nodes share pair anything.
* A shingle's nodes aren't paired all with all. In `rounds` rounds each node is tried with the one centre that it shares most shingles with; what links
  merges into components. Then all pairs of a shingle's nodes that are in different components are counted: in each pair one
  is outside the largest component that the shingle occurs in.

* In that last step a pair's parities, a bit for each of 128 residues of the hash, have to leave a link possible too: every differing bit is a shingle
  that only one of the two has.

Which shingles count as frequent is found from all documents (those that a batch of them holds twice), by a Bloom filter that keeps the most frequent ones
if it can't hold all. It decides the order only: no link is lost, whatever the order.

Cases: null and empty texts and texts without a word have no shingle and link with nothing; texts of fewer
than k words have one shingle, the whole sequence. Rows that share an id are one document. A row without an id
is in its text's component and links like any other; ids are below 2**62; a component's name is the least id in it, null if none of its rows has an id. Of centres that share equally many
shingles the one of the least hash is tried. An empty table gives an empty result. Columns other than the id and the text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import MOST_BITS, Bloom, cut, discard
from .words import as_long, chunks, mix, shingle_hashes

#: Fragments in which overlaps are counted.
FRAGMENTS = 8
#: The number of a row that holds a batch's repeated shingles; shingles whose repeats are counted at once, but for longer texts.
REPEATED, AT_ONCE = -1, 1 << 22


def _set_of(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct shingles of a text, sorted by hash; without a word none."""
    return np.unique(shingle_hashes(words, k if len(words) >= k else len(words))) if len(words) else np.empty(0, np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set."""
    return tuple(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(salt))) ^ np.uint64(len(s))) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def _sets(batch: pa.RecordBatch, k: int, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    for chunk in chunks(batch.column(1), lower=True, wanted=wanted):
        for row, words in chunk:
            yield row, _set_of(words, k)


def prefix(s: np.ndarray, t: int, support: int, often: np.ndarray) -> np.ndarray:
    """The set's first shingles in the global order; often tells of each of s, sorted by hash, whether it is frequent."""
    most = min(len(s), len(s) - -(-t * len(s) // 100) + support)
    rare = s[~often][:most]
    return np.concatenate([rare, s[often][: most - len(rare)]])


def parities(s: np.ndarray) -> np.ndarray:
    """For each of 128 residues of the hash, whether the set has an odd number of such shingles."""
    odd = np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles two sets share: counted in each fragment, and summed."""
    cuts = np.arange(FRAGMENTS + 1, dtype=np.uint64) << np.uint64(61)
    a, b = (np.append(np.searchsorted(s, cuts[:-1]), len(s)) for s in (x, y))
    return sum(len(np.intersect1d(x[a[f] : a[f + 1]], y[b[f] : b[f + 1]], assume_unique=True)) for f in range(FRAGMENTS))


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))


NOTHING = np.empty(0, np.int64)


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _digests(k: int):
    """mapInArrow: (id, text) into (id, d1, d2, n, h, c): two hashes of the set, and its size; rows of n = REPEATED hold the shingles h that c different
    sets of a batch have, two or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            sets: list[np.ndarray] = []
            seen: set = set()
            at_once = 0

            def add(*values) -> None:
                for to, v in zip(out, values, strict=True):
                    to.append(v)

            def repeated() -> None:
                h, c = np.unique(np.concatenate(sets) if sets else np.empty(0, np.uint64), return_counts=True)
                add(None, 0, 0, REPEATED, as_long(h[c > 1]), c[c > 1])
                sets.clear()

            for row, s in _sets(batch, k):
                d1, d2 = _digest(s) if len(s) else (0, 0)
                add(batch.column(0)[row].as_py(), d1, d2, len(s), NOTHING, NOTHING)
                if len(s) and d1 not in seen:
                    seen.add(d1)
                    sets.append(s)
                    at_once += len(s)
                if at_once >= AT_ONCE:
                    repeated()
                    at_once = 0
            repeated()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), _longs(out[1]), _longs(out[2]), pa.array(out[3], pa.int32()), _lists(out[4]), _lists(out[5])], ["id", "d1", "d2", "n", "h", "c"])

    return run


def _wanted(batch: pa.RecordBatch, maybe) -> np.ndarray:
    ids = batch.column(0)
    return maybe.value.has(ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)


def _prefixes(k: int, t: int, support: int, nodes, frequent):
    """mapInArrow: (id, text) into (node, n, prefix, o0, o1) of the ids that may be nodes; o: the parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, lists, odd = [], [], [], []
            for row, s in _sets(batch, k, _wanted(batch, nodes)):
                if len(s):
                    odd.append(parities(s))
                    node.append(batch.column(0)[row].as_py())
                    n.append(len(s))
                    lists.append(as_long(prefix(s, t, support, frequent.value.has(as_long(s)))))
            o = np.array(odd, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(n, pa.int32()), _lists(lists), pa.array(o[:, 0].copy()), pa.array(o[:, 1].copy())], ["node", "n", "prefix", "o0", "o1"])

    return run


def _tokens(shared):
    """mapInArrow: (node, n, prefix, o0, o1) into (h, node, n, place, first, o0, o1) of the shingles that two nodes may have; first: the place of the node's first one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, lengths = batch.column(2).flatten().to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.arange(len(h)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            at = np.flatnonzero(shared.value.has(h))
            first = np.zeros(batch.num_rows, np.int32)
            first[row[at][::-1]] = place[at][::-1]  # of several values for a row the last counts, which is its first one
            yield pa.RecordBatch.from_arrays([pa.array(h[at]), *(batch.column(i).take(pa.array(row[at])) for i in (0, 1)), pa.array(place[at].astype(np.int32)), pa.array(first[row[at]]), *(batch.column(i).take(pa.array(row[at])) for i in (3, 4))], ["h", "node", "n", "place", "first", "o0", "o1"])

    return run


def _texts(wanted):
    """mapInArrow: (id, text) of the ids that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_wanted(batch, wanted)))

    return run


def _compared(k: int):
    """mapInArrow: (a, na, b, nb, x, y) into (a, na, b, nb, overlap) of the texts x and y whose sets have na and nb shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [batch.column(i).to_pylist() for i in (1, 3)]
            shared, keep, known = [], [], {}
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = []
                for side in (0, 1):
                    ids, texts = part.column(2 * side), part.column(4 + side)
                    found = [known.get((ids[i], sizes[side][at + i])) for i in range(part.num_rows)]
                    fresh = np.array([f is None for f in found], bool)
                    for row, s in _sets(pa.RecordBatch.from_arrays([ids, texts], ["id", "text"]), k, fresh):
                        if found[row] is None:
                            found[row] = s
                    sets.append(found)
                # pairs come in the order of one side: its sets are kept for the rows that follow
                known = {(part.column(0)[i], sizes[0][at + i]): s for i, s in enumerate(sets[0])}
                for i, (x, y) in enumerate(zip(*sets, strict=True)):
                    keep.append(len(x) == sizes[0][at + i] and len(y) == sizes[1][at + i])
                    shared.append(overlap(x, y))
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(shared, pa.int64())], ["a", "na", "b", "nb", "overlap"])
            yield out.filter(pa.array(keep, pa.bool_()))

    return run


def _enough(t: int, shared: str) -> str:
    """As SQL: 100 * overlap >= t * union, of sets of na and nb shingles."""
    return f"{100 + t} * ({shared}) >= {t} * (na + nb)"


def _can(t: int, support: int) -> str:
    """As SQL, of a pair that shares a shingle at places i and j, as one of the first `support`, and nothing before places fa and fb: the sizes and places let them link."""
    return f"100 * least(na, nb) >= {t} * greatest(na, nb) and " + _enough(t, f"least(na - fa, nb - fb, {support} + na - i - 1, {support} + nb - j - 1)")


#: Names of rows without an id begin here.
UNNAMED = 1 << 62


class JaccardJoin:
    """The join of docs (columns id_col, text_col); each step is a table in the shared folder."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, percent: int = 85, support: int = 4, rounds: int = 1):
        self.k, self.t, self.support, self.rounds = k, percent, support, rounds
        # a row without an id has a name from its text, beyond all ids, so that it can be a node and never names a component
        unnamed = F.shiftrightunsigned(F.xxhash64(text_col), 2) + F.lit(UNNAMED)
        self.docs = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("id"), F.col(text_col).alias("text"))
        broadcast = docs.sparkSession.sparkContext.broadcast
        read = cut(self.docs.mapInArrow(_digests(k), "id long, d1 long, d2 long, n int, h array<long>, c array<long>"))
        self.sets = read.where(F.col("n") != REPEATED).select("id", "d1", "d2", "n")
        self.nodes = cut(self.sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("id").alias("node")))
        nodes = broadcast(Bloom.build(self.nodes.select("node").where("node is not null"), "node"))
        frequent = broadcast(Bloom.build(self._frequent(read.where(F.col("n") == REPEATED)), "h"))
        prefixes = cut(self.docs.mapInArrow(_prefixes(k, percent, support, nodes, frequent), "node long, n int, prefix array<long>, o0 long, o1 long"))
        # the smaller set of a pair has the shingle they share further in front than the larger one may
        front = F.expr(f"place < n - ({2 * percent} * n + {99 + percent}) div {100 + percent} + {support}")
        placed = prefixes.select("n", F.posexplode("prefix").alias("place", "h")).select("h", front.alias("front"))
        shared = placed.groupBy("h").agg(F.count(F.lit(1)).alias("many"), F.max("front").alias("front")).where("many > 1 and front").select("h")
        shared = broadcast(Bloom.build(cut(shared), "h", a_row=32))
        self.tokens = cut(prefixes.mapInArrow(_tokens(shared), "h long, node long, n int, place int, first int, o0 long, o1 long"))
        discard(prefixes)
        self._links = None

    @staticmethod
    def _frequent(repeated: DataFrame) -> DataFrame:
        """Of batches' repeated shingles: all, or as many of the most frequent ones as a filter holds."""
        counts = cut(repeated.select(F.inline(F.arrays_zip("h", "c"))).groupBy("h").agg(F.sum("c").alias("c")))
        level = F.floor(F.log2("c")).cast("int")
        sizes = {r.level: r.n for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}
        least = min(sizes, default=0)
        while sum(n for x, n in sizes.items() if x >= least) > MOST_BITS // 16:
            least += 1
        return counts.where(level >= least).select("h")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, na, b, nb): those that link, with their overlap, from the texts of both."""
        ends = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        wanted = pairs.sparkSession.sparkContext.broadcast(Bloom.build(ends, "node"))
        texts = self.docs.mapInArrow(_texts(wanted), "id long, text string")
        both = pairs.join(texts.toDF("b", "y"), "b").join(texts.toDF("a", "x"), "a").select("a", "na", "b", "nb", "x", "y")
        counted = both.mapInArrow(_compared(self.k), "a long, na int, b long, nb int, overlap long")
        # rows may repeat, and rows that share an id have several sets: the most alike decide
        return counted.where(_enough(self.t, "overlap")).groupBy("a", "na", "b", "nb").agg(F.max("overlap").alias("overlap"))

    def links(self) -> DataFrame:
        """Pairs (a, b) of nodes that link: enough of them to give every component, not all of a dense one."""
        if self._links is not None:
            return self._links
        found = tried = None
        for i in range(1, self.rounds + 2):
            named = self._named(found)
            pairs = self._with_centres(named, i) if i <= self.rounds else self._crossing(named)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = cut(pairs)
            new = cut(self._verified(pairs))
            tried = pairs.select("a", "b") if tried is None else tried.union(pairs.select("a", "b"))
            found = new if found is None else found.union(new)
        self._links = found
        return found

    def _named(self, found: DataFrame | None) -> DataFrame:
        """The tokens with their nodes' components (part) and, once links are found, how many nodes these have."""
        if found is None:
            return self.tokens.withColumn("part", F.col("node"))
        parts = components(found.select("a", "b"))
        parts = cut(parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", F.col("component").alias("part"), "size"))
        return self.tokens.join(parts, "node", "left").withColumns({"part": F.coalesce("part", "node"), "size": F.coalesce("size", F.lit(1).cast("long"))})

    def _with_centres(self, named: DataFrame, i: int) -> DataFrame:
        """Each node with one other: of its shingles' centres the one that it shares most of them with.

        The first round's centres are the nodes that have the shingle furthest in front, so those with fewest rare ones; others are taken by hash.
        """
        order = [F.xxhash64("node", F.lit(i)), F.col("node")]
        centre = F.first(F.struct("part", F.col("node").alias("a"), F.col("n").alias("na"), F.col("place").alias("i"), F.col("first").alias("fa"))).over(Window.partitionBy("h").orderBy(*([F.col("place")] if i == 1 else []), *order))
        met = named.withColumn("c", centre).where("part != c.part").select("c.a", "c.na", "c.i", "c.fa", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("place").alias("j"), F.col("first").alias("fb")).where(_can(self.t, self.support))
        # either side of a pair may have chosen the other
        counted = self._supported(met)
        side = lambda x, y: counted.select(F.col(x).alias("b"), F.struct("many", F.xxhash64(y).alias("o"), "a", "na", "b", "nb").alias("p"))
        best = side("a", "b").union(side("b", "a")).groupBy("b").agg(F.max("p").alias("p"))
        return best.select("p.a", "p.na", "p.b", "p.nb").distinct()

    def _crossing(self, named: DataFrame) -> DataFrame:
        """All pairs of a shingle's nodes that are in two components: one isn't in the largest one there."""
        size = F.col("size") if "size" in named.columns else F.lit(1)
        named = named.withColumn("top", F.max(F.struct(size.alias("size"), "part")).over(Window.partitionBy("h"))["part"])
        others = named.where("part != top").selectExpr("h", "part as pa", "node as a", "n as na", "place as i", "first as fa", "o0 as p0", "o1 as p1")
        every = named.selectExpr("h", "part", "part != top as other", "node as b", "n as nb", "place as j", "first as fb", "o0", "o1")
        # a pair of which both are outside comes from the one of them that is less
        pairs = others.join(every, "h").where("pa != part and (not other or a < b)").where(_can(self.t, self.support))
        pairs = pairs.where(_enough(self.t, "(na + nb - bit_count(o0 ^ p0) - bit_count(o1 ^ p1)) div 2"))
        return self._supported(pairs).drop("many")

    def _supported(self, met: DataFrame) -> DataFrame:
        """(a, na, b, nb, many) of pairs that come once for each shingle they share: those that share as many as a pair that links."""
        counted = met.selectExpr("least(a, b) as a", "if(a < b, na, nb) as na", "greatest(a, b) as b", "if(a < b, nb, na) as nb").groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("many"))
        return counted.where(f"many >= least({self.support}, ({self.t} * greatest(na, nb) + 99) div 100)")

    def _same_id(self) -> DataFrame:
        """Links (a, b) between the nodes of rows that share an id with different sets."""
        named = self.sets.where("n > 0 and id is not null")
        several = named.groupBy("id").agg(F.min("d1").alias("low"), F.max("d1").alias("high")).where("low != high").select("id")
        return named.join(several, "id", "left_semi").join(self.nodes, ["d1", "d2", "n"]).where("id != node").selectExpr("id as a", "node as b")

    def membership(self) -> DataFrame:
        """(id, n_shingles, component) of every row of docs."""
        named = lambda c: F.when(F.col(c) < UNNAMED, F.col(c)).alias(c)
        parts = components(self.links().select("a", "b").union(self._same_id()))
        nodes = self.nodes.join(parts, "node", "left").select("d1", "d2", "n", F.coalesce("component", "node").alias("component"))
        sets = self.sets.select("id", "n", "d1", "d2")
        with_words = sets.where("n > 0").join(nodes, ["d1", "d2", "n"]).select("id", F.col("n").cast("long").alias("n_shingles"), "component")
        out = with_words.unionByName(sets.where("n = 0").select("id", F.col("n").cast("long").alias("n_shingles"), F.col("id").alias("component")))
        return out.select(named("id"), "n_shingles", named("component"))
