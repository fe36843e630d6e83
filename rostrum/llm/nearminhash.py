"""Near-duplicate documents: MinHash signatures joined through an inverted index of their coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.common import by_group, frugal, kept, sifted
from rostrum.llm.graph import components
from rostrum.llm.shingles import shingle_sets
from rostrum.operators.common import dealt_join

#: Coordinates of a signature.
COORDINATES = 48
#: Rows of one posting list that are compared with each other in one cell.
BLOCK = 512
#: Coordinates counted before rows are skipped.
STRIDE = 8
#: Shingles hashed to all coordinates at once.
SLICE = 2048


def match_threshold(percent: int, coordinates: int) -> int:
    """Coordinates that must agree: five standard deviations below what the similarity predicts."""
    p = percent / 100
    return max(1, int(np.floor(coordinates * p - 5 * np.sqrt(coordinates * p * (1 - p)))))


def multipliers(coordinates: int) -> np.ndarray:
    """One odd factor per coordinate."""
    return np.random.default_rng(6).integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Tokens ``coordinate * 2^32 + minimum``, one per coordinate, of a non-empty set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), SLICE):
        np.minimum(least, (hashes[at : at + SLICE, None] * factors[None, :]).min(axis=0), out=least)
    return (np.arange(len(factors), dtype=np.int64) << 32) | (least >> np.uint64(32)).astype(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, coordinates: int = COORDINATES) -> DataFrame:
    """``id, text_hash, n, node, tokens``: hash of the text, set size, a key of the set (from a 128-bit fingerprint), and its signature (null if empty)."""
    factors = multipliers(coordinates)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, one, two, tokens = [], [], [], []
            for hashes in shingle_sets(batch.column(2)):
                sizes.append(len(hashes))
                one.append(int(hashes.sum(dtype=np.uint64).view(np.int64)))
                two.append(int(np.bitwise_xor.reduce(hashes * (hashes | np.uint64(1))).view(np.int64)) if len(hashes) else 0)
                tokens.append(signature(hashes, factors) if len(hashes) else None)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["id", "text_hash", "n", "d1", "d2", "tokens"])

    rows = named(docs, id_col, text_col).mapInArrow(frugal(hashed), "id long, text_hash long, n long, d1 long, d2 long, tokens array<long>")
    return rows.select("id", "text_hash", "n", F.xxhash64("d1", "d2", "n").alias("node"), "tokens")


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, text_hash, text``: rows are told apart by id and text, since ids may repeat."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))


def prefix_postings(reps: DataFrame, coordinates: int, least: int) -> DataFrame:
    """``(token, id)``: every representative under the rarest of its tokens that other documents have too.

    Two signatures that agree in ``least`` of ``coordinates`` places share one of the first ``coordinates - least + 1``
    tokens in any common order; in the order of frequency those skip the long lists of widespread passages. Tokens of
    one document alone come first in that order and need no posting.
    """
    long = reps.select("id", F.explode("tokens").alias("token"))
    often = kept(long.groupBy("token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "token-counts")
    shared = long.join(often.withColumnRenamed("token", "_token"), F.col("token") == F.col("_token")).drop("_token")
    whole = Window.partitionBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = shared.withColumn("_alone", F.lit(coordinates) - F.count(F.lit(1)).over(whole))
    ranked = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy("id").orderBy("often", "token")))
    return kept(ranked.filter(F.col("_alone") + F.col("_rank") <= coordinates - least + 1).select("token", "id"), "postings")


def agreeing(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``least`` places."""
    left = reps.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = reps.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b")
    same = F.size(F.array_intersect("ta", "tb"))
    return both.filter(same >= least).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets overlap in ``percent`` of their union, or more."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True):
                inter = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter))
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(frugal(exact), "a long, b long")


def _cells(lists: DataFrame) -> DataFrame:
    """Rows of lists cut into blocks of about :data:`BLOCK`, every two blocks of a list in a cell of their own.

    A row meets the rows on the other side of its cells; on the diagonal it is on both sides.
    """
    dealt = lists.withColumn("_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    cell = F.concat_ws("/", "token", low, high)
    return dealt.select(
        cell.alias("cell"), (F.col("_block") <= F.col("_other")).alias("left"), (F.col("_block") >= F.col("_other")).alias("right"),
        "token", "id", "component", "prefix", "tokens",
    )


def _flag(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table[name].to_numpy(zero_copy_only=False), bool)


def candidates(cells: DataFrame, least: int) -> DataFrame:
    """``cell, id, component, left, right``: rows with a partner in their cell that they may be linked with.

    Partners are of another component, agree in ``least`` places of the signature, and share no smaller token of
    their prefixes, so that two documents are candidates in one list only. No pair leaves the task.
    """

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        token = table["token"][0].as_py()
        ids, comps = table["id"].to_numpy(), table["component"].to_numpy()
        left, right = _flag(table, "left"), np.flatnonzero(_flag(table, "right"))
        sigs = table["tokens"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        before = [x[x < token] for x in (np.asarray(p) for p in table["prefix"].to_pylist())]
        active = np.zeros(len(table), bool)
        width = sigs.shape[1]
        for i in np.flatnonzero(left):
            other = right[(ids[right] != ids[i]) & (comps[right] != comps[i])]
            collisions = np.zeros(len(other), np.int64)
            for at in range(0, width, STRIDE):  # rows that cannot come to enough collisions any more are skipped
                collisions += (sigs[other, at : at + STRIDE] == sigs[i, at : at + STRIDE]).sum(axis=1)
                able = collisions + max(0, width - at - STRIDE) >= least
                other, collisions = other[able], collisions[able]
                if not len(other):
                    break
            if len(other) and len(before[i]):
                sizes = [len(before[j]) for j in other]
                shared = np.isin(np.concatenate([before[j] for j in other]), before[i])
                other = other[np.bincount(np.repeat(np.arange(len(other)), sizes), shared, minlength=len(other)) == 0]
            if len(other):
                active[i] = True
                active[other] = True
        if active.any():
            yield from table.filter(pa.array(active)).select(["cell", "id", "component", "left", "right"]).combine_chunks().to_batches()

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(frugal(by_group("cell", solve)), "cell string, id long, component long, left boolean, right boolean")


def cross_links(active: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``a, b``: what the confirmed links of each cell join, as a link of each id with the smallest one it reaches.

    Whole shingle sets are intersected in the cell, all partners of a document at once.
    """

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, comps = table["id"].to_numpy(), table["component"].to_numpy()
        left, right = np.flatnonzero(_flag(table, "left")), np.flatnonzero(_flag(table, "right"))
        sets = list(shingle_sets(table["text"].combine_chunks()))
        sizes = np.array([len(x) for x in sets])
        if not len(left) or not len(right):
            return
        hashes = np.concatenate([sets[j] for j in right])
        owner = np.repeat(right, sizes[right])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        nodes, place = np.unique(ids, return_inverse=True)
        parent = np.arange(len(nodes))
        for i in left:
            lo, hi = np.searchsorted(hashes, sets[i], "left"), np.searchsorted(hashes, sets[i], "right")
            runs = hi - lo
            ends = np.cumsum(runs)
            at = np.repeat(lo - np.concatenate(([0], ends))[:-1], runs) + np.arange(ends[-1] if len(ends) else 0)
            inter = np.bincount(owner[at], minlength=len(ids))
            hit = (inter > 0) & (100 * inter >= percent * (sizes[i] + sizes - inter)) & (comps != comps[i]) & (ids != ids[i])
            own = place[i]
            for j in place[np.flatnonzero(hit)].tolist():
                x, y = own, j
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                parent[max(x, y)] = min(x, y)
        for x in range(len(nodes)):
            parent[x] = parent[parent[x]]
        moved = np.flatnonzero(parent != np.arange(len(nodes)))
        if len(moved):
            yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[parent[moved]])], ["a", "b"])

    told = active.join(texts, "id").select("cell", "id", "component", "left", "right", "text")
    return told.repartition("cell").sortWithinPartitions("cell").mapInArrow(frugal(by_group("cell", solve)), "a long, b long")


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, coordinates: int = COORDINATES
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``, ``text_hash``.

    Documents are linked when the intersection of their shingle sets is at least ``percent`` of the union; components
    are named by their smallest id, which is the one kept. Documents without words are linked with nothing; so are
    rows with a null id, whose component is null and which are kept. Rows that share an id but not a text are documents
    of their own; if they lie in one component, that with the smallest ``text_hash`` (``xxhash64`` of the text) is
    kept. An empty table gives an empty result; other columns are not read.

    Equal sets become one node. Nodes are posted under the coordinates of their signatures (see
    :func:`prefix_postings`). First each node is compared with the head of the list that it shares most often,
    which joins large groups with one comparison per member; then lists that still hold several components are
    compared across those components in blocks (:func:`candidates`, :func:`cross_links`). Every link is confirmed on
    the whole sets; only texts of nodes that are compared leave the documents.
    """
    least = match_threshold(percent, coordinates)
    sigs = kept(signatures(docs, id_col, text_col, coordinates), "signatures")
    full = sigs.filter("n > 0 AND id IS NOT NULL")
    first = F.min(F.struct(F.col("id").alias("id"), F.col("text_hash").alias("text_hash"))).alias("first")
    reps = kept(full.groupBy("node").agg(first, F.first("tokens").alias("tokens")), "nodes")
    sig = reps.select(F.col("node").alias("id"), "tokens")

    postings = prefix_postings(sig, coordinates, least)
    heads = kept(postings.groupBy("token").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "heads")
    heads = heads.withColumnRenamed("token", "_token")
    near = postings.join(heads, F.col("token") == F.col("_token")).filter("id <> head").groupBy("id", "head").agg(F.count(F.lit(1)).alias("n"))
    best = near.groupBy(F.col("id").alias("a")).agg(F.max_by("head", F.struct("n", "head")).alias("b"))
    stars = kept(agreeing(best, sig, least), "stars")

    listed = postings.join(heads, F.col("token") == F.col("_token"), "left_semi").select(F.col("id").alias("node")).distinct()
    wanted = kept(listed.join(reps.select("node", "first"), "node").select("node", "first.*"), "wanted")
    texts = sifted(named(docs, id_col, text_col), ["id", "text_hash"], wanted)
    texts = kept(texts.dropDuplicates(["id", "text_hash"]).join(wanted, ["id", "text_hash"]).select(F.col("node").alias("id"), "text"), "texts")
    links = kept(confirmed(stars, texts, percent), "links")
    labels = kept(components(links), "labels").select(F.col("id").alias("_id"), "component")

    tagged = postings.join(labels, F.col("id") == F.col("_id"), "left").select("token", "id", F.coalesce("component", "id").alias("component"))
    tagged = kept(tagged, "tagged")
    several = tagged.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    several = kept(several.filter("lo <> hi"), "several").select(F.col("token").alias("_token"), "n")
    open_lists = kept(tagged.join(several, F.col("token") == F.col("_token")).drop("_token"), "open-lists")
    prefixes = open_lists.groupBy("id").agg(F.collect_list("token").alias("prefix")).join(sig, "id")
    cells = _cells(open_lists.join(prefixes, "id"))
    rest = kept(cross_links(kept(candidates(cells, least), "candidates"), texts, percent), "rest")
    groups = components(links.unionByName(rest)).select(F.col("id").alias("_id"), "component")
    nodes = kept(reps.select("node", "first").join(groups, F.col("node") == F.col("_id"), "left").select("node", "first", F.coalesce("component", "node").alias("component")), "named")
    firsts = nodes.groupBy(F.col("component").alias("_component")).agg(F.min("first").alias("_first"))
    of_node = nodes.join(firsts, F.col("component") == F.col("_component")).select("node", "_first")
    # copies share a node, so the rows of a node may be very many
    inside = dealt_join(full.select("id", "text_hash", "n", "node"), kept(of_node, "of-node"), ["node"])
    inside = inside.select("id", "n", F.col("_first.id").alias("component_id"), (F.struct("id", "text_hash") == F.col("_first")).alias("kept"), "text_hash")
    alone = sigs.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"), F.lit(True).alias("kept"), "text_hash")
    return inside.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept", "text_hash")
