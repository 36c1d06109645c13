"""A written vector index: inverted lists around centres, searched in part with exact ranks, or whole by bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import cut, discard
from .similarity import SLACK, assigned, dealt, ordered

#: Lists at most, rows that the centres are fitted on at most (about), and rounds of the fit.
LISTS, FIT_ROWS, ROUNDS = 1024, 32768, 8
#: Rows of a part of a list, as files.
PART_ROWS = 8192
#: Queries that a calibration asks exactly, about.
CALIBRATION = 64


def _fit(x: np.ndarray, many: int) -> np.ndarray:
    """Unit centres of unit vectors by spherical k-means; lists without rows go."""
    centres = x[np.random.default_rng(0).choice(len(x), many, replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        centres = sums[norm > 0] / norm[norm > 0, None]
    return centres


class VectorIndex:
    """An index in a folder: centres (list, centre, radius, n, parts), and rows (id, vec) by list and part.

    Vectors are of one dimension and finite; zero vectors are left out, as they have no angle. Every row is in the list
    of its nearest centre, and a list's rows are dealt into parts, so that a crowded list is many tasks.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """Index vectors (id, vec): centres are fitted on about FIT_ROWS of the rows by a hash of their ids, all rows are indexed."""
        index = cls(vectors.sparkSession, path)
        rows = vectors.where(F.exists("vec", lambda x: x != 0)).select("id", "vec")
        n, dims = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        lot = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(max(1, n // FIT_ROWS))) == 0
        some = rows.where(lot).select("vec").limit(2 * FIT_ROWS).collect()
        x = np.array([r["vec"] for r in some], np.float64).reshape(len(some), dims or 0)
        many = min(lists or LISTS, len(x), lists or max(1, int(np.sqrt(n))))
        centres = _fit(x / np.linalg.norm(x, axis=1, keepdims=True), many) if len(x) else np.zeros((0, 0))
        index._write(rows, centres, dims or 0, "overwrite")
        return index

    def _write(self, rows: DataFrame, centres: np.ndarray, dims: int, mode: str) -> None:
        if not len(centres):
            rows.limit(0).withColumns({"list": F.lit(0), "part": F.lit(0)}).write.mode(mode).parquet(f"{self.path}/rows")
            self.spark.createDataFrame([], "list int, centre array<double>, radius double, n long, parts int").write.mode("overwrite").parquet(f"{self.path}/centres")
            return
        placed = cut(assigned(rows, centres, dims).withColumnsRenamed({"pivot": "list"}))
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
        parts = sizes.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int"))
        dealt = placed.join(F.broadcast(parts.select("list", "parts")), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # LISTS rows at most
        dealt.select("id", "vec", "list", "part").repartition("list", "part").sortWithinPartitions("list", "part").write.mode(mode).parquet(f"{self.path}/rows")
        found = {r["list"]: r for r in parts.collect()}
        table = [(i, c.tolist(), found[i]["radius"], found[i]["n"], found[i]["parts"]) if i in found else (i, c.tolist(), -1.0, 0, 1) for i, c in enumerate(centres)]
        self.spark.createDataFrame(table, "list int, centre array<double>, radius double, n long, parts int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        discard(placed)

    def centres(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit centres, radii and parts by list; LISTS rows at most."""
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()
        return np.array([r["centre"] for r in rows], np.float64), np.array([r["radius"] for r in rows]), np.array([r["parts"] for r in rows], np.int64)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def add(self, vectors: DataFrame) -> None:
        """Put more rows (id, vec) into the lists of their nearest centres, which stay; ids that are there already are not looked for."""
        centres, radii, parts = self.centres()
        if not len(centres):
            raise ValueError("an index of no rows has no lists: build it anew")
        rows = vectors.where(F.exists("vec", lambda x: x != 0)).select("id", "vec")
        placed = cut(assigned(rows, centres, centres.shape[1]).withColumnsRenamed({"pivot": "list"}))
        many = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("list") + 1)
        grown = {r["list"]: r for r in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
        # the wider radii come first: a search between the two writes looks at more than it has to, and misses nothing
        old = {r["list"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/centres").select("list", "n").collect()}
        table = [(i, c.tolist(), max(float(radii[i]), grown[i]["radius"] if i in grown else -1.0), old[i] + (grown[i]["n"] if i in grown else 0), int(parts[i])) for i, c in enumerate(centres)]
        self.spark.createDataFrame(table, "list int, centre array<double>, radius double, n long, parts int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")
        placed.withColumn("part", F.pmod(F.xxhash64("id"), many).cast("int")).select("id", "vec", "list", "part").write.mode("append").parquet(f"{self.path}/rows")
        discard(placed)

    def _bands(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By list the first of its bands, how many it has, and its rows: near lists share a band up to a block of rows, and a crowded list has several."""
        centres, _, _ = self.centres()
        rows = np.array([r["n"] for r in self.spark.read.parquet(f"{self.path}/centres").select("list", "n").orderBy("list").collect()], np.int64)
        first, span = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64)
        if not len(rows):
            return first, span, rows
        most = max(1, min(max(V.BLOCK_ROWS, -(-int(rows.sum()) // V.SPREAD)), V.COMPONENTS // max(1, centres.shape[1])))
        band, held = 0, 0
        for i in ordered(centres):
            span[i] = max(1, -(-rows[i] // most))
            if held and held + rows[i] > most:
                band, held = band + 1, 0
            first[i], held = band, held + rows[i]
            if span[i] > 1:
                band, held = band + span[i], 0
        return first, span, rows

    def _probed(self, queries: DataFrame, probes: int, bands: tuple[np.ndarray, np.ndarray, np.ndarray], least: bool = False) -> DataFrame:
        """queries (query_id, vec, least) by band, with the lists of it to look at: the nearest `probes`, or with least those further ones that can hold a row of that similarity."""
        centres, radii, _ = self.centres()
        first, span, rows = bands

        def add(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            angles = np.arccos(np.clip(x @ centres.T, -1, 1))
            near = np.argsort(angles, axis=1, kind="stable")[:, :probes]
            if not least:
                on = np.zeros(angles.shape, bool)
            else:
                on = angles <= np.arccos(np.clip(batch.column("least").to_numpy(zero_copy_only=False), -1, 1))[:, None] + radii + SLACK
            np.put_along_axis(on, near, not least, axis=1)
            return on & (rows > 0)

        return dealt(queries.select("query_id", "vec", "least"), add, first, span, "band", "lists")

    def _found(self, probed: DataFrame, k: int, bands: tuple[np.ndarray, np.ndarray, np.ndarray], asked: int) -> DataFrame:
        """(query_id, id, sim) of the k best of each band that a query looks at; of `asked` queries."""
        first, span, _ = bands
        where = self.spark.createDataFrame([(i, int(f), int(s)) for i, (f, s) in enumerate(zip(first, span, strict=True))], "list int, first int, span int")
        dims = len(r["centre"]) if (r := self.spark.read.parquet(f"{self.path}/centres").first()) else 1
        nq = max(1, -(-asked * dims // V.COMPONENTS), min(V.SPREAD, -(-asked // V.BLOCK_ROWS)))
        q = probed.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int"))
        band = (F.col("first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("span"))).cast("int")
        v = self.rows().join(F.broadcast(where), "list").withColumn("band", band).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))  # LISTS rows
        v = v.select(*[F.col(c).alias(f"v_{c}") for c in ("band", "qb", "list", "id", "vec")])
        kind = probed.schema["query_id"].dataType.simpleString()

        def top(x: pa.Table, y: pa.Table) -> pa.Table:
            if not x.num_rows or not y.num_rows:
                return pa.table({"query_id": x["query_id"].slice(0, 0), "id": y["v_id"].slice(0, 0), "sim": pa.array([], pa.float64())})
            best = V.Best(V.units(x["vec"]), V.units(y["v_vec"]), y["v_id"], k, x["least"].to_numpy())
            lists = x["lists"].combine_chunks()
            into = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            o = np.argsort(into, kind="stable")
            into, row = into[o], row[o]
            own = y["v_list"].to_numpy()
            at = np.lexsort((best.place, own))
            held, starts = np.unique(own[at], return_index=True)
            for n, columns in zip(held, np.split(at, starts[1:]), strict=True):
                best.meet(row[np.searchsorted(into, n) : np.searchsorted(into, n, "right")], columns)
            i, j, s = best.found()
            return pa.table({"query_id": x["query_id"].take(pa.array(i)), "id": y["v_id"].take(pa.array(j)), "sim": s})

        return q.groupBy("band", "qb").cogroup(v.groupBy("v_band", "v_qb")).applyInArrow(top, f"query_id {kind}, id string, sim double")

    def _best(self, found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("sim"), "id")
        return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, id, sim, place): the k nearest of the rows in the `probes` lists nearest each query, exactly ranked; ties to the smaller id, cosines to 9 places."""
        bands = self._bands()
        asked = queries.select("query_id", "vec", F.lit(-1.0).alias("least"))
        return self._best(self._found(self._probed(asked, probes, bands), k, bands, asked.count()), k)

    def exact(self, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
        """The same over all rows: `probes` lists give each query a similarity to beat, then all lists that can beat it are looked at.

        By the triangle inequality a list whose centre is farther than the angle to beat and its radius holds nothing better.
        """
        bands = self._bands()
        asked = cut(queries.select("query_id", "vec"))
        n = asked.count()
        first = cut(self._best(self._found(self._probed(asked.withColumn("least", F.lit(-1.0)), probes, bands), k, bands, n), k).drop("place"))
        floors = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("sim").alias("s")).select("query_id", F.when(F.col("n") >= k, F.col("s")).alias("floor"))
        again = asked.join(floors, "query_id", "left").withColumn("least", F.coalesce(F.col("floor") - 1e-9, F.lit(-1.0))).select("query_id", "vec", "least")
        return self._best(first.unionByName(self._found(self._probed(again, probes, bands, least=True), k, bands, n)), k)

    def calibrated(self, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """Lists to look at so that the share `recall` of the k nearest is found, as measured on about CALIBRATION of the queries.

        These are answered exactly; a neighbour is found once its list is looked at, so its list's place among the
        query's lists says how many it takes.
        """
        n = queries.count()
        some = cut(queries.where(F.pmod(F.xxhash64("query_id", F.lit(5)), F.lit(max(1, n // CALIBRATION))) == 0).select("query_id", "vec"))
        near = self.exact(some, k).select("query_id", "id").join(self.rows().select("id", "list"), "id").join(some, "query_id").select("vec", "list").collect()  # k rows a sampled query
        if not near:
            return 1
        centres, _, _ = self.centres()
        x = np.array([r["vec"] for r in near], np.float64)
        angles = -(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) @ centres.T)
        place = (angles < angles[np.arange(len(x)), [r["list"] for r in near]][:, None]).sum(axis=1) + 1
        return int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)])
