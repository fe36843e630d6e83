"""Near-duplicate vectors: coarse lists, product-quantised residuals, exact cosine on what they leave."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.common import by_group, frugal, kept
from rostrum.llm.graph import components

#: Vectors the quantiser is fitted on; the bound of what reaches the driver.
SAMPLE = 20_000
#: Vectors of a coarse list, about, and most lists that the sample can place.
LIST, LISTS = 512, 2048
#: Dimensions of a subspace and codewords of its codebook.
SUBSPACE, CODEWORDS = 4, 256
#: Standard deviations by which a pair may straddle the border of two lists and still be found.
BORDER = 3.0
#: Vectors of a list, and of its queries, that meet in one cell.
BLOCK = 1024


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's steps from a seeded choice of rows; empty ones stay where they are."""
    centres = x[np.random.default_rng(3).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, x[:, j], minlength=len(centres)) for j in range(x.shape[1])], axis=1)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] - 2.0 * x @ centres.T + (centres * centres).sum(axis=1)[None, :])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    return np.concatenate([squared(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


@dataclass
class Quantizer:
    """Coarse centres and, per subspace of the residuals, codewords. Vectors have length one.

    ``spread`` is the second moment of the residuals over their mean square, so its trace is one.
    """

    centres: np.ndarray
    books: list[np.ndarray]
    spread: np.ndarray

    @property
    def width(self) -> int:
        return self.centres.shape[1]

    def fitted(self, x: np.ndarray) -> np.ndarray:
        """Rows of the quantiser's width: shorter ones end in zeros, longer ones are folded for the index only."""
        out = np.zeros((len(x), self.width))
        for j in range(0, x.shape[1], self.width):
            part = x[:, j : j + self.width]
            out[:, : part.shape[1]] += part
        return out

    def codes(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codeword numbers of residuals and how far the coded point lies from the true one."""
        code = np.empty((len(residual), len(self.books)), np.uint8)
        error = np.zeros(len(residual))
        for m, book in enumerate(self.books):
            part = residual[:, m * SUBSPACE : (m + 1) * SUBSPACE]
            code[:, m] = nearest(part, book)
            error += ((part - book[code[:, m]]) ** 2).sum(axis=1)
        return code, np.sqrt(error)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of each query's subvectors to all codewords."""
        return [squared(residual[:, m * SUBSPACE : (m + 1) * SUBSPACE], book) for m, book in enumerate(self.books)]

    @cached_property
    def borders(self) -> tuple[np.ndarray, np.ndarray]:
        """Per pair of lists, the distance of their centres and the share of a displacement's square along it.

        Displacements spread as residuals do, or evenly over all dimensions where that gives more: vectors of low rank
        have few directions to move in, so more of a displacement falls along the line between two centres.
        """
        gap = np.sqrt(squared(self.centres, self.centres))
        inner = self.centres @ self.spread @ self.centres.T
        along = np.diag(inner)[:, None] + np.diag(inner)[None, :] - 2.0 * inner
        return gap, np.maximum(along / np.maximum(gap * gap, 1e-24), 1.0 / self.width)

    def probes(self, x: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists that can hold a neighbour within ``radius``.

        A neighbour in another list lies beyond the plane between the two centres, at most ``radius`` away; the length
        of a displacement along the plane's normal has its standard deviation from :attr:`borders`.
        """
        far = squared(x, self.centres)
        best = far.argmin(axis=1)
        gap, share = self.borders
        depth = (far - far[np.arange(len(x)), best][:, None]) / (2.0 * np.maximum(gap[best], 1e-12))
        close = depth <= radius * np.minimum(1.0, BORDER * np.sqrt(share[best]))
        close[np.arange(len(x)), best] = True
        return [np.flatnonzero(row) for row in close]


def fit(sample: np.ndarray, total: int) -> Quantizer:
    """A quantiser for ``total`` vectors from a sample of them."""
    lists = max(1, min(LISTS, total // LIST, len(sample) // 8))
    centres = k_means(sample, lists)
    residual = sample - centres[nearest(sample, centres)]
    books = [k_means(residual[:, m : m + SUBSPACE], CODEWORDS) for m in range(0, sample.shape[1], SUBSPACE)]
    return Quantizer(centres, books, residual.T @ residual / max(float((residual * residual).sum()), 1e-300))


def _checked(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, size, vec``: comparable vectors as bytes of doubles, scaled to length one; others with null ``vec``."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for label, vector in zip(batch.column(1), batch.column(2), strict=True):
                vec = None
                if label.is_valid and vector.is_valid and len(vector.values) and not vector.values.null_count:
                    x = vector.values.to_numpy().astype(np.float64) + 0.0
                    top = np.abs(x).max()
                    if np.isfinite(top) and top > 0:
                        x = x / top
                        vec = x / np.sqrt(x @ x)
                sizes.append(0 if vec is None else len(vec))
                out.append(None if vec is None else vec.tobytes())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["id", "label", "size", "vec"])

    picked = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return picked.mapInArrow(frugal(scale), "id long, label string, size int, vec binary")


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _placed(classes: DataFrame, quantizer: Quantizer, radius: float) -> DataFrame:
    """Each class once under its list (``query`` false) and once under every list it probes (``query`` true).

    ``lists`` tells the other side what the row asks: all probed lists of a listed row, the own list of a query.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                part = batch.slice(first, 2048)
                sizes = part.column(2).to_numpy()
                for size in np.unique(sizes):
                    own = pa.Table.from_batches([part]).filter(pa.array(sizes == size))
                    x = quantizer.fitted(_stacked(own["vec"]))
                    home = nearest(x, quantizer.centres)
                    probed = quantizer.probes(x, radius)
                    take = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), [len(p) for p in probed])])
                    lists = np.concatenate([home, *probed]).astype(np.int32)
                    query = np.arange(len(take)) >= len(x)
                    got = own.take(pa.array(take))
                    told = [*probed, *home[take[len(x) :]][:, None]]
                    told = pa.ListArray.from_arrays(np.cumsum([0, *map(len, told)]).astype(np.int32), np.concatenate(told).astype(np.int32))
                    table = pa.table(
                        [got["label"], got["size"], pa.array(lists), pa.array(query), got["id"], got["copies"], told, got["vec"]],
                        ["label", "size", "list", "query", "id", "copies", "lists", "vec"],
                    )
                    yield from table.combine_chunks().to_batches()

    return classes.select("id", "label", "size", "vec", "copies").mapInArrow(frugal(place), "label string, size int, list int, query boolean, id long, copies long, lists array<int>, vec binary")


def _cells(placed: DataFrame) -> DataFrame:
    """Rows dealt to cells of at most about :data:`BLOCK` listed vectors and as many queries."""
    key = ["label", "size", "list"]
    counts = placed.groupBy(*key).agg(F.sum((~F.col("query")).cast("int")).alias("n"), F.sum(F.col("query").cast("int")).alias("q"))
    counts = kept(counts.filter("n > 0 AND q > 0"), "list-sizes")
    blocks = counts.select(*[F.col(k).alias(f"_{k}") for k in key], F.ceil(F.col("n") / BLOCK).cast("int").alias("_n"), F.ceil(F.col("q") / BLOCK).cast("int").alias("_q"))
    on = (F.col("label") == F.col("_label")) & (F.col("size") == F.col("_size")) & (F.col("list") == F.col("_list"))
    own = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("_q")).otherwise(F.col("_n"))).cast("int")
    dealt = placed.join(blocks, on).withColumn("_own", own)
    others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("_n")).otherwise(F.col("_q")) - 1)
    dealt = dealt.withColumn("_other", F.explode(others))
    listed, asking = F.when(F.col("query"), F.col("_other")).otherwise(F.col("_own")), F.when(F.col("query"), F.col("_own")).otherwise(F.col("_other"))
    cell = F.concat_ws("/", "size", "list", listed, asking, "label")
    return dealt.select(cell.alias("cell"), "list", "query", "id", "copies", "lists", "vec")


def _linked(cells: DataFrame, quantizer: Quantizer, least: float, radius: float) -> DataFrame:
    """Per cell and vector: ``links`` found, and the ``root`` of what the cell joins it with.

    A link between two lists can be found from both sides or from one. Each side counts its own end; the end of a
    listed vector that does not ask in the query's list is counted with the query's.
    """

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        query = np.asarray(table["query"].to_numpy(zero_copy_only=False), bool)
        ids, copies, vec = table["id"].to_numpy(), table["copies"].to_numpy(), _stacked(table["vec"])
        if not query.any() or query.all():
            return
        centre = quantizer.centres[table["list"][0].as_py()]
        flat = quantizer.fitted(vec)
        code, error = quantizer.codes(flat[~query] - centre)
        nodes, place = np.unique(ids, return_inverse=True)
        parent = np.arange(len(nodes))
        links = np.zeros(len(nodes), np.int64)
        asked, listed = np.flatnonzero(query), np.flatnonzero(~query)
        told = table["lists"].combine_chunks()
        told, size = told.flatten().to_numpy(), told.value_lengths().to_numpy()
        begin = np.cumsum(size) - size
        home = told[begin].astype(np.int64)  # of queries
        wide = len(quantizer.centres)
        asks = np.sort((np.repeat(np.arange(len(size)), size) * wide + told)[np.repeat(~query, size)])
        for at in range(0, len(asked), 128):
            own = asked[at : at + 128]
            far = np.zeros((len(own), len(listed)))
            for m, tables in enumerate(quantizer.tables(flat[own] - centre)):
                far += tables[:, code[:, m]]
            near = np.sqrt(far) <= radius + error[None, :] + 1e-9
            a, b = np.nonzero(near & (ids[own][:, None] != ids[listed][None, :]))
            good = np.einsum("ij,ij->i", vec[own[a]], vec[listed[b]]) >= least
            a, b = own[a[good]], listed[b[good]]
            np.add.at(links, place[a], copies[b])
            alone = ~np.isin(b * wide + home[a], asks)
            np.add.at(links, place[b[alone]], copies[a[alone]])
            x, y = place[a], place[b]
            while len(x):
                x, y = parent[x], parent[y]
                apart = x != y
                x, y = x[apart], y[apart]
                if not len(x):
                    break
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = parent[parent]
                    if (up == parent).all():
                        break
                    parent = up
        used = (links > 0) | (parent != np.arange(len(nodes)))
        used[parent[used]] = True
        if used.any():
            yield pa.record_batch([pa.array(nodes[used]), pa.array(links[used]), pa.array(nodes[parent[used]])], ["id", "links", "root"])

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(frugal(by_group("cell", solve)), "id long, links long, root long")


def near_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, sample: int = SAMPLE
) -> DataFrame:
    """One row per input row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors of equal labels and lengths are linked when their cosine in double precision is at least ``least``; a null
    label or vector, an empty one, one of length zero or with null or non-finite components links with nothing, and so
    does a row with a null id. ``n_links`` counts the other rows a vector is linked with; components are named by
    their smallest id, which alone is kept. An empty table gives an empty result.

    Equal vectors are one class with a count. Classes lie in the coarse list of their nearest centre and ask in every
    list whose border is near enough (see :meth:`Quantizer.probes`). There the table-lookup distance drops what
    cannot be near: it errs by the coding error at most, which is known for each vector, so no pair of the list is
    lost. The rest is compared exactly. A link found from one side only counts for both ends. Per cell only counts and a spanning forest leave the task. The quantiser is
    fitted on at most about ``sample`` vectors.
    """
    vectors = kept(_checked(rows, id_col, vector_col, label_col), "vectors")
    valid = vectors.filter("vec IS NOT NULL AND id IS NOT NULL")
    classes = kept(valid.groupBy("label", "size", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    total = classes.count()
    out = vectors.select("id", "label", "size", "vec")
    if total:
        every = max(1, -(-total // sample))
        wide = classes.groupBy("size").count().orderBy(F.desc("count"), "size").first()["size"]
        picked = classes.filter((F.col("size") == wide) & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).select("id", "vec").toArrow()
        if not len(picked):
            picked = classes.filter(F.col("size") == wide).select("id", "vec").limit(sample).toArrow()
        order = np.argsort(picked["id"].to_numpy(), kind="stable")
        quantizer = fit(_stacked(picked["vec"])[order], total)
        radius = float(np.sqrt(max(0.0, 2.0 - 2.0 * least)))
        placed = kept(_placed(classes, quantizer, radius), "placed")
        found = kept(_linked(_cells(placed), quantizer, least, radius), "found")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        groups = components(found.filter("id <> root"), "id", "root").withColumnRenamed("id", "_cid")
        links = links.withColumnRenamed("id", "_lid")
        classed = classes.join(links, F.col("id") == F.col("_lid"), "left").join(groups, F.col("id") == F.col("_cid"), "left")
        classed = classed.select(
            F.col("label").alias("_label"), F.col("size").alias("_size"), F.col("vec").alias("_vec"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
        )
        classed = kept(classed, "vector-results")
        on = (F.col("label") == F.col("_label")) & (F.col("size") == F.col("_size")) & (F.col("vec") == F.col("_vec")) & F.col("id").isNotNull()
        out = out.join(classed, on, "left")
    else:
        out = out.withColumn("n_links", F.lit(0)).withColumn("component_id", F.col("id"))
    kind = rows.schema[id_col].dataType
    own = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == own, F.lit(True)).alias("kept"),
    )
