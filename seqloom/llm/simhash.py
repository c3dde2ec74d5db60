"""SimHash near-duplicates with BK-trees.

Fingerprints are 64-bit SimHashes of word shingles. Two that differ in at most ``RADIUS`` bits are
linked; documents are grouped by the connected components of those links.

BK-trees: a child hangs under its parent at the edge of their Hamming distance, and a query at
distance d follows only edges from d - radius to d + radius. One tree over everything grows with
the corpus, and so would its broadcast. The trees are therefore sharded: the fingerprint is cut into
``BLOCKS`` blocks, and within the radius at least ``AGREE`` of them agree, so every pair of neighbours
shares one of the ten two-block routes (or, for other radii, of the choices of ``agree`` blocks). A shard tree holds the distinct fingerprints of a route
value, at most ``SHARD`` of them, and goes only to the task whose queries share the route. Larger
routes are dealt over several shards, and their queries visit each of them. That is exact and
nothing is dropped.

Inside a shard, links are joined by union-find, so a group of m fingerprints emits fewer than m
links. Components are found by contracting links towards the smallest neighbour, in rounds of
DataFrame joins over written tables.

Defined cases: null text counts as empty; a text without words has fingerprint zero and is linked
like any other; ids that repeat share the component of their rows; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, slices, small_batches, tidy, whole_text, written

RADIUS = 3
BLOCKS, AGREE = 5, 2
SHARD = 4096
SEED = 42
PIECE = 1 << 16


def shingle_hashes(text: str, shingle: int) -> list[int]:
    """XXH64 of the word shingles of ``text``, ASCII letters lower-cased; a shorter text is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :], strict=False)]


def fingerprint(text: str, shingle: int = 3, distinct: bool = False) -> int:
    """SimHash of the word shingles of ``text``, each as often as it stands or, if ``distinct``, once."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    hashes = np.array(list(set(hashes)) if distinct else hashes, dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), PIECE):
        part = hashes[i : i + PIECE]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, distinct: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    small_batches(docs.sparkSession)

    @F.arrow_udf("long")
    def of(text: pa.Array) -> pa.Array:
        got = [fingerprint(t, shingle, distinct) for _, part in slices(text) for t in part]
        return pa.array(np.array(got, dtype=np.uint64).view(np.int64))

    return docs.select(F.col("doc_id").cast("long"), of(whole_text()).alias("fp"))


class BKTree:
    """Distinct integers; children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        self.values.append(value)
        self.children.append({})
        while new:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                return
            at = self.children[at][d]

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            edges = self.children[at]
            if edges:
                todo += [child for e, child in edges.items() if d - radius <= e <= d + radius]
        return found


def shard_links(tree_values: list[int], queries: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that span the groups of the tree's values and the queries near them."""
    tree, parent, found = BKTree(), {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for value in tree_values + queries:
        for at in tree.near(value, radius):
            a, b = root(tree.values[at]), root(value)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((tree.values[at], value))
        if len(tree.values) < len(tree_values):
            tree.add(value)
    return found


def _routes(fp, blocks, agree):
    """One long per choice of ``agree`` blocks: the choice's number, then the bits of its blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        key = F.lit(n).cast("long")
        for i in chosen:
            bits = edges[i + 1] - edges[i]
            key = F.shiftleft(key, bits) + F.shiftrightunsigned(fp, edges[i]).bitwiseAND((1 << bits) - 1)
        keys.append(key)
    return F.array(*keys)


def links(fps: DataFrame, radius: int = RADIUS, shard: int = SHARD, blocks: int = BLOCKS, agree: int = AGREE) -> DataFrame:
    """Links (a, b) within the radius that connect the distinct fingerprints in column ``fp``.

    Exact as long as ``blocks - radius >= agree``: that many blocks of two neighbours are equal at least.
    """
    if blocks - radius < agree:
        raise ValueError("too few blocks for this radius")
    routed = fps.select("fp", F.explode(_routes(F.col("fp"), blocks, agree)).alias("route"))
    large = routed.groupBy("route").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard)
    large = written(large.select("route", F.ceil(F.col("n") / shard).cast("int").alias("shards")), "large-routes")
    dealt = routed.join(large, "route", "left").withColumn("home", F.pmod(F.xxhash64("fp"), F.coalesce("shards", F.lit(1))).cast("int"))
    dealt = dealt.select("route", "fp", "home", F.explode(F.sequence(F.lit(0), F.col("home"))).alias("part"))
    dealt = dealt.repartition("route", "part").sortWithinPartitions("route", "part", "home", "fp")

    def run(batches):
        left = None
        for batch in batches:
            now = [np.asarray(batch.column(i)) for i in range(4)]
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now, strict=True)]
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[3] != now[3][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            left = [x[cut:] for x in now]
            yield from _grouped([x[:cut] for x in now], radius)
        if left is not None:
            yield from _grouped(left, radius)

    return dealt.select("route", "fp", "home", "part").mapInArrow(run, "a long, b long")


def _grouped(columns, radius):
    route, fp, home, part = columns
    if not len(route):
        return
    edges = np.flatnonzero((route[1:] != route[:-1]) | (part[1:] != part[:-1])) + 1
    starts, ends = np.r_[0, edges], np.r_[edges, len(route)]
    found = []
    for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
        values = fp[s:e].astype(np.uint64).tolist() if fp.dtype != np.int64 else fp[s:e].view(np.uint64).tolist()
        own = int((home[s:e] == part[s]).sum())  # sorted by home: what the shard holds comes first
        found += shard_links(values[:own], values[own:], radius)
    if found:
        pairs = np.array(found, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the undirected links (a, b).

    Each round points every node to its smallest neighbour (or itself) and contracts the links; the
    nodes that stay are at most those that some node points to, so rounds grow as the logarithm.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "step")
        if roots is None:
            roots = step.select(F.col("a").alias("node"), F.col("to").alias("root"))
        else:
            moved = step.select(F.col("a").alias("root"), "to")
            roots = written(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        heads = step.select("a", F.col("to").alias("x"))
        tails = step.select(F.col("a").alias("b"), F.col("to").alias("y"))
        next_edges = edges.join(heads, "a").join(tails, "b").filter("x <> y")
        edges = written(next_edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, itself included."""
    table = written(fingerprints(docs, shingle), "fingerprints")
    least = written(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(least.select("fp"), radius, shard)).withColumnRenamed("node", "fp")
    joined = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(joined.join(smallest, "root").select("fp", "component_id"), "components")
    return table.join(by_fp, "fp").select("doc_id", "fp", "component_id")


SIMILARITY = 0.8
WORDS = 5
DEAL = 256
# Shingles that many texts share go last in the order of prefixes. Any order finds every pair; this one keeps the join
# small, so it may rest on a part of the texts and on a bounded list.
ORDER_PART, ORDER_COUNT, ORDER_LIST = 32, 3, 200_000
PROFILE = "fp long, size int, short int, keys array<long>, sketch binary"


def text_digest() -> F.Column:
    """SHA-256 of the text with A-Z lower-cased."""
    return F.unhex(F.sha2(ascii_lower(whole_text()).cast("binary"), 256))


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of ``text``, sorted."""
    return np.unique(np.array(shingle_hashes(text, shingle), dtype=np.uint64))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """How many shingles fall into each of a power of two of buckets, two to four in each on average; 255 stands for more."""
    width = 1 << max(2, (len(shingles) // 2).bit_length() - 1)
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.minimum(counts, 255).astype(np.uint8)


def can_be_similar(x: np.ndarray, y: np.ndarray, x_size: int, y_size: int, similarity: float) -> bool:
    """False only if sets with these sketches can't have the similarity: buckets bound what they have in common."""
    if min(x_size, y_size) < similarity * max(x_size, y_size):
        return False
    if x.max() == 255 or y.max() == 255:
        return True
    width = min(len(x), len(y))
    x, y = (v.reshape(-1, width).sum(axis=0, dtype=np.int64) for v in (x, y))
    both = int(np.minimum(x, y).sum())
    return both >= similarity * (x_size + y_size - both)


def _profile(similarity, shingle, last):
    @F.arrow_udf(PROFILE)
    def of(text: pa.Array) -> pa.Array:
        rows = []
        for _, part in slices(text):
            for t in part:
                words = shingle_set(t, shingle)
                n, keys = len(words), words.view(np.int64)
                moved = last.value[np.searchsorted(last.value, keys)] == keys
                # The longer set of a pair shares at least ``similarity`` of its shingles, so one of them is among the first ones.
                long = n - int(np.ceil(similarity * n - 1e-9)) + 1
                first = np.concatenate([keys[~moved], keys[moved]])[:long] if n else np.zeros(1, dtype=np.int64)
                short = n - int(np.ceil(2 * similarity / (1 + similarity) * n - 1e-9)) + 1
                fp = int(np.uint64(fingerprint(t, 1, True)).view(np.int64))
                rows.append((fp, n, short, first, sketch(words).tobytes()))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, ["fp", "size", "short", "keys", "sketch"])

    return of(F.col("text"))


def _common(table: DataFrame, words: int) -> np.ndarray:
    """At most ``ORDER_LIST`` shingles that many of a part of the distinct texts share, sorted; the greatest one stands for none."""

    @F.arrow_udf("array<long>")
    def of(text: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, words).view(np.int64) for _, part in slices(text) for t in part], pa.list_(pa.int64()))

    part = table.filter(F.pmod(F.xxhash64("digest"), F.lit(ORDER_PART)) == 0).groupBy("digest").agg(F.min("text").alias("text"))
    counts = part.select(F.explode(of(F.col("text"))).alias("key")).groupBy("key").count()
    common = counts.filter(F.col("count") >= ORDER_COUNT).orderBy(F.desc("count"), "key").limit(ORDER_LIST)
    return np.sort(np.array([*(r["key"] for r in common.select("key").collect()), np.iinfo(np.int64).max], dtype=np.int64))


def _both(pairs: DataFrame, table: DataFrame, *names: str) -> DataFrame:
    """The pairs (a, b) with the columns of both nodes as x_... and y_..."""
    for side, name in (("a", "x"), ("b", "y")):
        pairs = pairs.join(table.select(F.col("node").alias(side), *[F.col(c).alias(f"{name}_{c}") for c in names]), side)
    return pairs


def _checked(table: DataFrame, one: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose texts have the similarity, written. Sketches rule most others out before any text is read."""

    @F.arrow_udf("boolean")
    def possible(x: pa.Array, y: pa.Array, n: pa.Array, m: pa.Array) -> pa.Array:
        views = ([np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in side] for side in (x, y))
        return pa.array([can_be_similar(*v, similarity) for v in zip(*views, n.to_pylist(), m.to_pylist(), strict=True)], pa.bool_())

    @F.arrow_udf("binary")
    def sets(text: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t, words).tobytes() for _, part in slices(text) for t in part], pa.binary())

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        keep = []
        for u, v in zip(x, y, strict=True):
            u, v = (np.frombuffer(w.as_buffer(), dtype=np.uint64) for w in (u, v))
            both = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(both >= similarity * (len(u) + len(v) - both))
        return pa.array(keep, pa.bool_())

    spark = table.sparkSession
    known = one.select("node", F.col("p.sketch").alias("sketch"), F.col("p.size").alias("size"))
    left = _both(pairs, known, "sketch", "size").filter(possible("x_sketch", "y_sketch", "x_size", "y_size")).select("a", "b")
    left = written(left, "possible-pairs")
    members = left.select(F.col("a").alias("node")).union(left.select("b")).distinct().join(one.select("node", "digest"), "node")
    texts = table.hint("merge").join(members, "digest").groupBy("node").agg(F.min("text").alias("text"))
    texts = written(texts.select("node", sets("text").alias("words")), "shingle-sets")
    tidy(spark)
    found = written(_both(left, texts, "words").filter(alike("x_words", "y_words")).select("a", "b"), "similar-pairs")
    tidy(spark, texts, left)
    return found


def prefixes(one: DataFrame) -> DataFrame:
    """Of each text the first shingles, those that other texts have too: key, node, size, pos, early, and n, the texts of the key.

    Two sets of the similarity share a shingle among the first of both in any common order (prefix filter): of the longer
    set 1 - s of its shingles, of the shorter one 1 - 2s / (1 + s), which ``early`` marks.
    """
    rows = one.select("node", F.col("p.size").alias("size"), F.col("p.short").alias("short"), F.posexplode("p.keys").alias("pos", "key"))
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(shared, "shared-keys")
    tidy(one.sparkSession)
    found = rows.select("key", "node", "size", "pos", (F.col("pos") < F.col("short")).alias("early")).join(shared, "key")
    found = written(found, "shared-prefixes")
    tidy(one.sparkSession, shared)
    return found


def hub_pairs(shared: DataFrame) -> DataFrame:
    """One partner (a, b) for each text: the hub of most of its shared leading shingles.

    A shingle's hub is the text, of those that have it, whose leading shingles most texts have: of a group of edited copies that is
    the text they were made from, or one close to it. So a group is linked by as many pairs as it has texts.
    """
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame"))
    famed = shared.select("key", "node").join(fame, "node")
    hubs = famed.groupBy("key").agg(F.max(F.struct(F.col("fame"), (-F.col("node")).alias("hub"))).alias("h"))
    hubs = hubs.select("key", (-F.col("h.hub")).alias("hub"))
    votes = shared.select("key", "node").join(hubs, "key").filter("hub <> node").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("node").agg(F.max(F.struct(F.col("n"), (-F.col("hub")).alias("hub"))).alias("v"))
    return best.select((-F.col("v.hub")).alias("a"), F.col("node").alias("b"))


def prefix_pairs(shared: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """Every pair (a, b) of nodes from different groups that can have the similarity, written; ``groups`` holds node and root.

    What stands after the shared shingle bounds the overlap. Shingles found in one group only are no keys, and a key with many texts is
    dealt over pairs of blocks.
    """
    rows = shared.select("key", "node", "size", "pos", "early").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = written(rows, "grouped-prefixes")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s")
    keys = keys.select("key", F.ceil(F.col("n") / DEAL).cast("int").alias("parts"))
    dealt = rows.join(keys, "key").withColumn("home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "node", "root", "size", "pos", "early", "home", F.least("home", "part").alias("lo"), F.greatest("home", "part").alias("hi"))
    dealt = written(dealt, "dealt-prefixes")
    tidy(shared.sparkSession, rows)
    x = dealt.filter("home = lo").select("key", "lo", "hi", *[F.col(c).alias(f"x_{c}") for c in ("node", "root", "size", "pos", "early")])
    y = dealt.filter("home = hi").select("key", "lo", "hi", *[F.col(c).alias(f"y_{c}") for c in ("node", "root", "size", "pos", "early")])
    met = x.join(y, ["key", "lo", "hi"]).filter("x_root <> y_root and (lo < hi or x_node < y_node)")
    total, rest = F.col("x_size") + F.col("y_size"), F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos"))
    met = met.filter(F.least("x_size", "y_size") + 1e-6 >= similarity * F.greatest("x_size", "y_size"))
    met = met.filter((1 + similarity) * rest + 1e-6 >= similarity * total)
    met = met.filter(F.when(F.struct("x_size", "x_node") < F.struct("y_size", "y_node"), F.col("x_early")).otherwise(F.col("y_early")))
    pairs = written(met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct(), "prefix-pairs")
    tidy(shared.sparkSession, dealt)
    return pairs


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, radius: int = 4, blocks: int = 6, agree: int = 2) -> DataFrame:
    """digest, doc_id, keep: of every distinct text its digest and smallest id, and whether it is the first of its group.

    Groups are linked by the given Jaccard similarity over word shingles, or more. A SimHash of ``words``-word shingles lies
    far apart even for similar texts of a few hundred words, so the BK-trees search the SimHash of the distinct words. What they
    find, and each text with a hub of the texts that share its leading shingles, is checked on the texts' shingle sets: both are
    linear in the texts, also in a large group of copies. Links within the radius are thinned, and some pairs lie outside it,
    so an exact join (``prefix_pairs``) then finds every pair whose texts are not yet in one checked group, and these are
    checked too. Texts equal after lower-casing A-Z are one text from the start. Ids may repeat: what is grouped are texts, and
    the first of a group is the one with the smallest (id, digest). Rows without an id count with an id above all others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    table = docs.select(F.col("doc_id").cast("long"), text_digest().alias("digest"), whole_text().alias("text"))
    last = spark.sparkContext.broadcast(_common(table, words))
    profiled = table.select("doc_id", "digest", _profile(similarity, words, last).alias("p"))
    one = profiled.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min("p").alias("p"))
    one = written(one.withColumn("node", F.monotonically_increasing_id()), "distinct-texts")  # numbers stay, as they are written
    tidy(spark)
    heads = written(one.groupBy(F.col("p.fp").alias("fp")).agg(F.min("node").alias("head")), "fingerprint-heads")
    same = one.select("node", F.col("p.fp").alias("fp")).join(heads, "fp").select(F.col("head").alias("a"), F.col("node").alias("b"))
    found = written(links(heads.select("fp"), radius, blocks=blocks, agree=agree).distinct(), "fingerprint-links")
    tidy(spark)
    near = found.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    shared = prefixes(one)
    first = hub_pairs(shared)
    pairs = same.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).unionByName(first)
    pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = written(pairs.distinct(), "text-pairs")
    groups = components(_checked(table, one, pairs, similarity, words))
    tidy(spark, pairs, found)
    pairs = prefix_pairs(shared, groups, similarity)
    late = _checked(table, one, pairs, similarity, words)
    tidy(spark, pairs, shared)
    root = lambda name: groups.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    late = late.join(root("a"), "a", "left").join(root("b"), "b", "left")
    joined = components(late.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")))
    last.destroy()
    rooted = one.select("digest", "doc_id", "node").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = rooted.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("root", F.coalesce("top", "root"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("digest").alias("t"))
    rooted = written(rooted.select("digest", "doc_id", "root", rank.alias("rank")), "text-groups")
    firsts = rooted.groupBy("root").agg(F.min("rank").alias("first"))
    return rooted.join(firsts, "root").select("digest", "doc_id", F.col("first.d").alias("component_id"), (F.col("rank") == F.col("first")).alias("keep"))
