"""MinHash near-dedup by an inverted join on signature coordinates.

Documents with equal shingle sets are one node.  A node's signature has one minimum
for each coordinate, and every coordinate-value pair is a posting key.  Two sets of
similarity 0.8 collide in ``MATCH`` of the ``COORDINATES`` keys or more but for about
one pair in a million, so that a pair must meet in one of both nodes' rarest
``COORDINATES - MATCH + 1`` keys: the prefix filter, which skips the lists of frequent
keys as long as a node has enough others.

Short posting lists give their pairs.  A long list is first tied to three leaders, one
of them the member whose keys are the most frequent, that is nearest to what the
list has in common.  If its members are then in one component, nothing is left to
find.  Else a list of a few blocks is compared by pairs of blocks, which count
the collisions of members of different components, each pair only in the first list
that it shares.  Full sets are compared for pairs at the match threshold, where they
stand: only links leave the task.

Longer lists are not compared pair by pair.  Lists with one leader are a group, and the
leader is its centre.  Two members of which not both are linked with the centre can only
be similar if they also share shingles that the centre has not, but for members smaller
than the centre, which meet in a list of their own.  These shingles are the posting
keys of the next level, again with a prefix filter and lists, short and long.  Only lists
that are still long after ``LEVELS`` levels go through all pairs of their blocks.

All links are confirmed on the full shingle sets; components are contracted by
Spark joins.

Defined cases: null or wordless texts have no shingles, link with nothing and are
kept; fewer words than a shingle count as one shingle; repeated rows are copies
of each other; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.components import connected_components

from . import common as C
from .op1_suffix_dedup import _packed

#: Words of `[^\x20\x09-\x0D]+`.
WORD = ~C.byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: Of similar sets, 38 of 48 places agree on average, with a deviation of 2.8.
COORDINATES, MATCH = 48, 25
#: Posting lists up to this length give all their pairs; longer ones go by leaders and blocks.
SMALL = 12
#: Up to so many blocks, a list is compared block by block, and a member sent to a bounded number of pairs.
FEW_BLOCKS = 4
#: How often longer lists are taken apart by the differences from a centre; what is still longer then is compared block by block too.
LEVELS = 3
#: Members of a block, and its shingles, about.
BLOCK, BLOCK_SHINGLES = 128, 1 << 20
MEMBERS = ["rid", "comp", "n", "sig", "earlier", "packed"]


def shingle_sets(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct k-word shingles of each row, in order."""
    raw = C.lower_ascii(raw)
    start, end, words_at = C.words_of(raw, at, WORD)
    words = C.words_hash(raw, start, end)
    n = np.diff(words_at)
    rows, hashes = [], []
    whole = C.windows_hash(words, k)
    many = np.flatnonzero(n >= k)
    size = n[many] - k + 1
    row = np.repeat(many, size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(words_at[:-1][many], size)
    rows.append(row)
    hashes.append(C.mix(whole[place]) if len(place) else np.empty(0, np.uint64))
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        if len(few):
            rows.append(few)
            hashes.append(C.mix(C.windows_hash(words, m)[words_at[:-1][few]] ^ C.U64(m)))
    row, hashed = np.concatenate(rows), np.concatenate(hashes)
    order = np.lexsort((hashed, row))
    row, hashed = row[order], hashed[order]
    new = np.append(True, (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])) if len(row) else np.empty(0, bool)
    return row[new], hashed[new]


def _seeds(n: int) -> np.ndarray:
    return C.mix(np.arange(1, n + 1).astype(np.uint64)) | C.U64(1)


@C.tidy
def _signatures(batches: Iterator[pa.RecordBatch], k: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, at in C.pieces(batch, 1 << 19):
            row, h = shingle_sets(raw, at, k)
            n = np.bincount(row, minlength=part.num_rows)
            have = np.flatnonzero(n)
            first = (np.cumsum(n) - n)[have]
            d1, d2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            signs = np.empty((len(have), coordinates), np.uint64)
            if len(have):
                d1[have] = np.add.reduceat(C.mix(h ^ C.U64(0xA5A5A5A5A5A5A5A5)), first)
                d2[have] = np.add.reduceat(C.mix(h ^ C.U64(0x5A5A5A5A5A5A5A5A)), first)
                for i, seed in enumerate(_seeds(coordinates)):
                    x = h * seed
                    x ^= x >> C.U64(32)
                    signs[:, i] = np.minimum.reduceat(x * C.U64(0xD6E8FEB86659FD93) + C.U64(i), first)
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, coordinates, 0))]).astype(np.int32)
            sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signs.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([part["rid"], part["doc_id"], pa.array(n, pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), sig], names=["rid", "doc_id", "n", "d1", "d2", "sig"])


def _similar(n1: str, n2: str, percent: int):
    """Whether set sizes allow the similarity at all."""
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _sets(packed: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of packed texts: (place in the list, hash)."""
    open_ = zstandard.ZstdDecompressor()
    texts = [open_.decompress(x) for x in packed]
    return shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), k)


def _shared(sets: list[tuple[np.ndarray, np.ndarray]], rows: list[int]) -> np.ndarray:
    """How many values each row of one table has in common with each row of another; sets: (row, value), distinct."""
    shared = np.intersect1d(sets[0][1], sets[1][1])
    both = np.zeros(rows, np.float32)
    for at in range(0, len(shared), 1 << 15):
        some = shared[at : at + (1 << 15)]
        has = []
        for (r, h), n in zip(sets, rows, strict=True):
            where = np.minimum(np.searchsorted(some, h), len(some) - 1)
            ok = some[where] == h
            matrix = np.zeros((n, len(some)), np.float32)
            matrix[r[ok], where[ok]] = 1
            has.append(matrix)
        both += has[0] @ has[1].T
    return both


@C.tidy
def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between two blocks: one for any two components that have any.

    Collisions are counted for members of different components, and pairs taken up
    only in the first list that they share; of those at the match threshold the full
    sets are compared, all at once.
    """
    for batch in batches:
        for i in range(batch.num_rows):
            sides = [batch[c][i].values for c in ("one", "two")]
            if not len(sides[1]):  # a block with itself
                sides[1] = sides[0]
            comp, n = ([x.field(f).to_numpy() for x in sides] for f in ("comp", "n"))
            low, high = np.minimum(n[0][:, None], n[1]), np.maximum(n[0][:, None], n[1])
            ok = (comp[0][:, None] != comp[1]) & (low * 100 >= high * percent)
            if not ok.any():
                continue
            signs = [x.field("sig").flatten().to_numpy().reshape(-1, COORDINATES) for x in sides]
            count = np.zeros(ok.shape, np.int16)
            for c in range(COORDINATES):
                count += signs[0][:, c, None] == signs[1][:, c]
            ok &= count >= MATCH
            if not ok.any():
                continue
            before = [(np.repeat(np.arange(len(x)), pc.list_value_length(x.field("earlier")).to_numpy()), x.field("earlier").flatten().to_numpy()) for x in sides]
            ok &= _shared(before, [len(x) for x in sides]) == 0
            own = [np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))]
            if not len(own[0]):
                continue
            sets = [_sets(x.field("packed").take(pa.array(y)).to_pylist(), k) for x, y in zip(sides, own, strict=True)]
            both = _shared(sets, [len(x) for x in own])
            size = [np.bincount(r, minlength=len(x)) for (r, _), x in zip(sets, own, strict=True)]
            x, y = np.nonzero(ok[np.ix_(*own)] & (100 * both >= percent * (size[0][:, None] + size[1] - both)))
            if len(x):
                x, y = own[0][x], own[1][y]
                _, first = np.unique(np.stack([comp[0][x], comp[1][y]]), axis=1, return_index=True)
                rids = [side.field("rid").to_numpy() for side in sides]
                yield pa.RecordBatch.from_arrays([pa.array(rids[0][x[first]]), pa.array(rids[1][y[first]])], names=["a", "b"])


@C.tidy
def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Keep pairs whose full shingle sets reach the similarity."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = [_sets(part[c].to_pylist(), k) for c in ("text_a", "text_b")]
            n = [np.bincount(r, minlength=part.num_rows) for r, _ in sets]
            row, h = np.concatenate([sets[0][0], sets[1][0]]), np.concatenate([sets[0][1], sets[1][1]])
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (h[1:] == h[:-1])], minlength=part.num_rows)
            ok = 100 * both >= percent * (n[0] + n[1] - both)
            yield pa.RecordBatch.from_arrays([part["a"].filter(pa.array(ok)), part["b"].filter(pa.array(ok))], names=["a", "b"])


@C.tidy
def _outside(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """How many shingles a set has in common with its group's centre, and keys of its other ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            g, first, of = np.unique(part["g"].to_numpy(), return_index=True, return_inverse=True)
            salt = C.mix(g.view(C.U64))
            sets = [_sets(x.to_pylist(), k) for x in (part["packed"], part["centre"].take(pa.array(first)))]
            keys = [C.mix(h ^ salt[x]) for (_, h), x in zip(sets, (of[sets[0][0]], sets[1][0]), strict=True)]
            row, inside = sets[0][0], np.isin(keys[0], keys[1])
            n, common = (np.bincount(x, minlength=part.num_rows) for x in (row, row[inside]))
            n_g = np.bincount(sets[1][0], minlength=len(g))[of]
            offsets = np.concatenate([[0], np.cumsum(n - common)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[0][~inside].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part["g"], part["rid"], *[pa.array(x, pa.int64()) for x in (n, n_g, common)], lists], names=["g", "rid", "n", "n_g", "common", "keys"])


def _parts(c: str, s: str):
    """Blocks for so many members and shingles."""
    return F.ceil(F.greatest(F.col(c) / BLOCK, F.col(s) / BLOCK_SHINGLES)).cast("int")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, comp) that links (a, b) tie together."""
    of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    ties = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    joined = C.stored(connected_components(ties, "a", "b"), "joined").withColumnRenamed("comp", "to")
    nodes = comp.unionByName(joined.select("node", F.col("node").alias("comp")).join(comp, "node", "left_anti"))
    return nodes.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))


class NearDuplicates:
    """Links and components of the near-duplicates of a table; see the module."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80) -> None:
        self.k, self.percent = k, percent
        self.rows = C.numbered(docs)
        slim = self.rows.select("rid", F.col("row.doc_id").cast("bigint").alias("doc_id"), "text")
        schema = "rid bigint, doc_id bigint, n bigint, d1 bigint, d2 bigint, sig array<bigint>"
        self.signed = C.stored(slim.mapInArrow(lambda it: _signatures(it, k, COORDINATES), schema), "signed")
        least = F.min(F.struct("rid", "sig")).alias("x")
        self.nodes = C.stored(self.signed.where("n > 0").groupBy("d1", "d2", "n").agg(least).select("d1", "d2", "n", "x.rid", "x.sig"), "nodes")
        self.comp = self._components()

    def _prefixes(self, keys: DataFrame, by: list[str], need, near) -> DataFrame:
        """rid, n, comp, score, keys: the keys of a prefix, least frequent first; pairs must share ``need`` of all.

        The score is the sum of frequencies, and ``near``.  keys: a row with the columns ``by`` for each key.
        """
        often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        of = keys.join(often, "key").groupBy(*by).agg(F.sum("c").alias("score"), F.sort_array(F.collect_list(F.struct("c", "key"))).alias("keys"))
        # keys of one node alone come first in the order; they use up the prefix but lead nowhere
        prefix = F.slice("keys", F.lit(1), F.greatest(F.lit(0), F.size("keys") - (need - 1)).cast("int"))
        comp = "comp" if "comp" in by else F.col("rid").alias("comp")
        return of.select("rid", "n", comp, (F.col("score") + near).alias("score"), F.transform(prefix, lambda x: x["key"]).alias("keys")).where(F.size("keys") > 0)

    def _components(self) -> DataFrame:
        """node, comp of all nodes with a link."""
        keys = self.nodes.select("rid", "n", F.explode("sig").alias("key"))
        prefixes = C.stored(self._prefixes(keys, ["rid", "n"], F.lit(MATCH), F.lit(0)), "prefixes")
        comp = more = None
        for level in range(LEVELS + 1):
            comp, wide = self._level(prefixes, comp, more, level == LEVELS)
            if wide is None:
                return comp
            prefixes, more = self._differences(wide, comp)

    def _level(self, prefixes: DataFrame, comp: DataFrame | None, more: DataFrame | None, last: bool) -> tuple[DataFrame, DataFrame | None]:
        """Components with the links of one table of lists, and (g, rid, n) of the lists that are too long to compare at once.

        comp, more: components and links found before, if any.  The last level compares all lists.
        """
        postings = prefixes.select("rid", "n", "comp", "score", F.explode("keys").alias("key"))
        leaders = [F.max_by("rid", F.struct("score", "rid")), F.min("rid"), F.min_by("rid", F.xxhash64("rid"))]
        size = postings.groupBy("key").agg(F.count(F.lit(1)).alias("m"), (F.min("comp") < F.max("comp")).alias("open"), *[x.alias(f"l{i}") for i, x in enumerate(leaders)])
        size = C.stored(size.where("open"), "keys")
        if comp is None:
            near_keys = postings.join(size.select("key"), "key", "left_semi").select("rid").distinct()
            self.texts = C.stored(_packed(self.rows.select("rid", "text")).join(near_keys, "rid", "left_semi"), "texts")
        lists = postings.join(size.where(F.col("m") <= SMALL).select("key"), "key").groupBy("key").agg(F.collect_list(F.struct("rid", "n", "comp")).alias("all"))
        ones = lists.select("all", F.explode("all").alias("x"))
        near = F.filter("all", lambda y: (y["rid"] > F.col("x.rid")) & (y["comp"] != F.col("x.comp")) & _similar(y["n"], F.col("x.n"), self.percent))
        small = ones.select(F.col("x.rid").alias("a"), F.explode(near).alias("y")).select("a", F.col("y.rid").alias("b"))
        big = size.where(F.col("m") > SMALL)
        tied = postings.join(big, "key").select(F.col("rid"), F.explode(F.array_distinct(F.array("l0", "l1", "l2"))).alias("l")).where("rid <> l")
        tied = tied.select(F.least("rid", "l").alias("a"), F.greatest("rid", "l").alias("b"))
        links = self._confirmed(small.unionByName(tied).distinct())
        comp = connected_components(links, "a", "b") if comp is None else _joined(comp, links.unionByName(more))
        if big.isEmpty():
            return comp, None
        comp = C.stored(comp, "comp")
        postings = prefixes.select("rid", "n", "keys", F.explode("keys").alias("key")).join(big.select("key"), "key")
        postings = postings.join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        long = C.stored(postings.select("key", "rid", "n", "comp", F.slice("keys", F.lit(1), (F.array_position("keys", F.col("key")) - 1).cast("int")).alias("earlier")), "long")
        sizes = long.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.min("comp").alias("comp0"), F.max("comp").alias("comp1"))
        open_ = C.stored(sizes.where("comp0 < comp1").select("key", _parts("c", "s").alias("parts")), "open")
        if open_.isEmpty():
            return comp, None
        full = lambda x: x.join(self.nodes.select("rid", "sig"), "rid").join(self.texts, "rid")
        one = full(long.join(open_.where("parts = 1").select("key"), "key")).groupBy("key").agg(F.collect_list(F.struct(*MEMBERS)).alias("one"))
        met = one.select("one", F.slice("one", 1, 0).alias("two"))
        in_blocks = F.lit(True) if last else F.col("parts") <= FEW_BLOCKS
        met = met.unionByName(self._blocks(long.join(open_.where("parts > 1").where(in_blocks).select("key"), "key"), full))
        wide = open_.where(~in_blocks).select("key")
        found = C.stored(met.mapInArrow(lambda it, k=self.k, p=self.percent: _compare(it, k, p), "a bigint, b bigint").distinct(), "more")
        comp = C.stored(_joined(comp, found), "comp")
        if wide.isEmpty():
            return comp, None
        return comp, C.stored(long.join(wide, "key").join(size.select("key", F.col("l0").alias("g")), "key").select("g", "rid", "n").distinct(), "wide")

    def _differences(self, wide: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Prefixes over what members have beyond the centre of their group; and links with centres.

        A pair of which not both are linked with the centre g shares at least p / (p + 100) of the sum of both
        sizes, less what the member with less of the centre has of it.  If that is above zero, the pair shares keys
        outside the centre, and the prefix filter holds for these.  It is not only if one of both is smaller
        than the centre and both have much of it: such members meet in one more list, whose centre is its smallest member.
        """
        centres = self.texts.join(wide.select(F.col("g").alias("rid")).distinct(), "rid", "left_semi").select(F.col("rid").alias("g"), F.col("packed").alias("centre"))
        of = wide.join(self.texts, "rid").join(centres, "g").select("g", "rid", "packed", "centre")
        of = of.mapInArrow(lambda it, k=self.k: _outside(it, k), "g bigint, rid bigint, n bigint, n_g bigint, common bigint, keys array<bigint>")
        groups = wide.groupBy("g").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("m"))
        of = of.join(groups, "g").join(comp.withColumnRenamed("node", "rid"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
        p, q = self.percent, 100 + self.percent
        other = F.greatest("least", F.ceil(F.col("n") * p / 100))
        own = F.ceil((p * (F.col("n") + other) - q * F.col("common")) / q)
        linked = q * F.col("common") >= p * (F.col("n") + F.col("n_g"))
        beyond = F.when(F.col("linked"), F.floor(p * (F.col("n") - F.col("n_g")) / q) + 1)
        of = C.stored(of.withColumn("linked", linked).withColumn("own", own).withColumn("need", F.greatest(F.lit(1), "own", beyond)).withColumn("near", F.col("common") * F.col("m")), "outside")
        by = ["g", "rid", "n", "comp", "need", "near"]
        prefixes = self._prefixes(of.select(*by, F.explode("keys").alias("key")), by, F.col("need"), F.col("near"))
        rest = of.where("own <= 0 AND (n < n_g OR NOT linked)").select("rid", "n", "comp", (-F.col("n")).alias("score"), F.array(F.xxhash64("g", F.lit("rest"))).alias("keys"))
        centre_comp = comp.select(F.col("node").alias("g"), F.col("comp").alias("comp_g"))
        more = of.where("linked AND rid <> g").join(centre_comp, "g", "left").where("comp <> coalesce(comp_g, g)").select(F.col("rid").alias("a"), F.col("g").alias("b"))
        return C.stored(prefixes.unionByName(rest), "prefixes"), more

    def _blocks(self, long: DataFrame, full: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Pairs of blocks (one, two) of long lists, without those inside a component."""
        # a large component is a cell of its own: its members are not compared with each other; all small ones share cell -1
        large = F.col("c") >= BLOCK // 2
        of = long.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
        of = of.groupBy("key").agg(F.collect_list(F.when(large, F.struct(F.col("comp").alias("cell"), _parts("c", "s").alias("parts")))).alias("large"), *[F.coalesce(F.sum(F.when(~large, F.col(x))), F.lit(0)).alias(f"m{x}") for x in ("c", "s")])
        small = F.array(F.struct(F.lit(-1).cast("bigint").alias("cell"), _parts("mc", "ms").alias("parts")))
        cells = of.select("key", F.filter(F.concat(small, "large"), lambda x: x["parts"] > 0).alias("cells"))
        # every member goes to all pairs that its block is in, so that pairs of blocks of one long list are dealt out evenly
        of_cell = lambda c: F.get(F.filter("cells", lambda x: x["cell"] == c), F.lit(0))
        members = long.join(cells, "key").withColumn("own", F.coalesce(of_cell(F.col("comp")), of_cell(F.lit(-1))))
        members = members.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("own.parts")).cast("int")).withColumn("cell", F.col("own.cell"))
        blocks = F.flatten(F.transform("cells", lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda b: F.struct(x["cell"].alias("cell"), b.alias("block")))))
        others = F.filter(blocks, lambda x: (x["cell"] != F.col("cell")) | (x["cell"] == -1))
        met = full(members).select("key", "cell", "block", F.struct(*MEMBERS).alias("member"), F.explode(others).alias("other"))
        first = (F.col("cell") < F.col("other.cell")) | ((F.col("cell") == F.col("other.cell")) & (F.col("block") <= F.col("other.block")))
        here, there = F.struct("cell", "block"), F.col("other")
        sides = [F.collect_list(F.when(x, F.col("member"))).alias(name) for x, name in ((F.col("first"), "one"), (~F.col("first"), "two"))]
        met = met.withColumn("first", first).groupBy("key", F.when(first, here).otherwise(there).alias("p"), F.when(first, there).otherwise(here).alias("q")).agg(*sides)
        return met.where("size(one) > 0 AND (p = q AND size(one) > 1 OR size(two) > 0)").select("one", "two")

    def _confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) those over the match threshold whose full sets are similar."""
        sig = lambda c: self.nodes.select(F.col("rid").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
        pairs = pairs.join(sig("a"), "a").join(sig("b"), "b").where(_similar("n_a", "n_b", self.percent))
        agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        pairs = C.stored(pairs.where(agree >= MATCH).select("a", "b"), "pairs")
        text = lambda c: self.texts.select(F.col("rid").alias(c), F.col("packed").alias(f"text_{c}"))
        full = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
        return C.stored(full.mapInArrow(lambda it, k=self.k, p=self.percent: _confirm(it, k, p), "a bigint, b bigint"), "links")

    def components(self) -> DataFrame:
        """rid, doc_id, n_shingles, component_id (least doc_id of the component), first (least rid with that doc_id)."""
        of = self.nodes.withColumnRenamed("rid", "node").join(self.comp, "node", "left").select("d1", "d2", "n", F.coalesce("comp", "node").alias("comp"))
        rows = C.stored(self.signed.select("rid", "doc_id", "n", "d1", "d2").join(of, ["d1", "d2", "n"], "left").select("rid", "doc_id", "n", F.coalesce("comp", -1 - F.col("rid")).alias("comp")), "members")
        least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
        first = rows.join(least.withColumnRenamed("component_id", "least"), "comp").where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("comp").agg(F.min("rid").alias("first"))
        return rows.join(least, "comp").join(first, "comp").select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "first")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns."""
    found = NearDuplicates(docs, **how)
    keep = found.components().where("rid = first").select("rid")
    return found.rows.join(keep, "rid", "left_semi").select("row.*")


def op5_minhash(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``NearDuplicates`` over all documents."""
    out = NearDuplicates(C.table(spark, sf_dir, "documents").select("doc_id", "text"), k=4).components()
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: Components of a similarity graph are beyond plain SQL at full size; brute force stands in.
SQL = None
