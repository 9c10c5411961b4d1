"""The accepted history as immutable suffix arrays on shared storage, asked by one batch at a time.

A segment is what one batch, or several merged ones, added: the sorted suffixes of its concatenated texts, cut into files of about ``CHUNK_ROWS``.  Tasks map the files into memory
and search them by bisection, so a batch touches pages in proportion to its own size times the logarithm of the history's.  Segments never change; two of
one rank are merged into a new one, so there are O(log n) of them.  Every attempt at a segment writes to files of a fresh name and the manifest lists the files of those that
succeeded: a lost executor, or a whole batch that failed, leaves nothing behind that counts.
"""

from __future__ import annotations

import io
import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.history import CLASS_OF, DENSE, HASH, ID, NONE, ORDERS, WORDS, BITS, SuffixArray, earliest, hex_to_long, sortable, suffix_column, upload_marks
from foliospark.runtime import checkpoint_folder, cut, shuffle_width

#: Suffixes of one file at most, about.
CHUNK_ROWS = 1 << 20
#: Suffixes of one file at least, where a segment has more.
LEAST_ROWS = 1 << 15
_ROW = "c int, u bigint, r1 bigint, r2 bigint, r3 bigint, id bigint"
_COLUMNS = ["c", "u", "r1", "r2", "r3", "id"]
_CHUNKS = "c int, first bigint, last bigint, n bigint, file string"


class Folder:
    """The files of one index, in a folder that all executors reach: a mounted one, whose files are mapped, or one of another file system by its address."""

    def __init__(self, path: str) -> None:
        self.path = re.sub("^file:/*", "/", path).rstrip("/")
        self.mounted = "://" not in self.path

    def _at(self, name: str) -> tuple[pafs.FileSystem, str]:
        fs, base = (pafs.LocalFileSystem(), self.path) if self.mounted else pafs.FileSystem.from_uri(self.path)
        return fs, f"{base}/{name}" if name else base

    def put(self, name: str, content: bytes) -> None:
        fs, path = self._at(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as f:
            f.write(content)

    def get(self, name: str) -> bytes:
        fs, path = self._at(name)
        with fs.open_input_stream(path) as f:
            return f.read()

    def remove(self) -> None:
        """Deletes the whole index."""
        fs, path = self._at("")
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)

    def save(self, name: str, array: np.ndarray) -> None:
        held = io.BytesIO()
        np.save(held, array)
        self.put(name, held.getvalue())

    def load(self, name: str) -> np.ndarray:
        return np.load(f"{self.path}/{name}", mmap_mode="r") if self.mounted else np.load(io.BytesIO(self.get(name)))

    def segments(self) -> list[dict]:
        try:
            return json.loads(self.get("manifest.json"))
        except FileNotFoundError:
            return []

    def publish(self, segments: list[dict]) -> None:
        """Makes ``segments`` the history in one step, then removes the files of all others."""
        new = f"manifest.{uuid.uuid4().hex}"
        self.put(new, json.dumps(segments).encode())
        fs, path = self._at("")
        fs.move(f"{path}/{new}", f"{path}/manifest.json")
        kept = {s["name"] for s in segments}
        for old in fs.get_file_info(pafs.FileSelector(path)):
            if old.type == pafs.FileType.Directory and old.base_name not in kept:
                fs.delete_dir(old.path)

    def check(self, spark: SparkSession) -> None:
        """Raises where a task can't see what the driver wrote: the folder is on one machine only."""
        if spark.sparkContext.master.startswith("local"):
            return
        token, tasks = f"seen.{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism
        self.put(token, b"seen")

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                self.get(token)
                yield pdf

        try:
            spark.range(0, tasks, 1, tasks).mapInPandas(look, "id bigint").count()
        finally:
            fs, path = self._at(token)
            fs.delete_file(path)

    def arrays(self, segment: dict) -> dict[int, SuffixArray]:
        """The suffix arrays of a segment, by class; files are opened when they are first asked."""
        by_class: dict[int, list] = {}
        for c, first, _, n, file in sorted(segment["chunks"]):
            by_class.setdefault(c, []).append((first, n, lambda file=file: tuple(self.load(f"{segment['name']}/{file}.{x}.npy") for x in "ui")))
        return {c: SuffixArray(chunks) for c, chunks in by_class.items()}

    def tails(self, segment: dict, c: int) -> list[np.ndarray]:
        """What follows the leading 64 bits of each suffix of a class, by chunk."""
        return [self.load(f"{segment['name']}/{file}.r.npy") for k, _, _, _, file in sorted(segment["chunks"]) if k == c]

    def rows(self, spark: SparkSession, segments: list[dict]) -> DataFrame:
        """The texts of segments as rows of the classes that all else is made from."""
        files = [(s["name"], c, file) for s in segments for c, _, _, _, file in s["chunks"] if c in (CLASS_OF[(0,)], HASH, ID)]
        if not files:
            return spark.createDataFrame([], _ROW)

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for name, c, file in zip(pdf["name"], pdf["c"], pdf["file"]):
                    u, i = (self.load(f"{name}/{file}.{x}.npy") for x in "ui")
                    r = self.load(f"{name}/{file}.r.npy") if c == HASH else np.zeros((len(u), 3), np.int64)
                    yield pd.DataFrame({"c": np.full(len(u), c, np.int32), "u": u, "r1": r[:, 0], "r2": r[:, 1], "r3": r[:, 2], "id": i})

        listed = spark.createDataFrame(files, "name string, c int, file string").repartition(min(len(files), shuffle_width(spark)))
        return listed.mapInPandas(read, _ROW)

    def write(self, texts: DataFrame, dense: int = DENSE) -> dict:
        """A new segment of ``texts`` (rows of the first class, upload hashes and ids), suffix-sorted; not part of the history until it is published."""
        spark = texts.sparkSession
        texts = cut(texts)
        first = texts.where(F.col("c") == CLASS_OF[(0,)]).select(sortable(F.col("u")).alias("value"), "id")
        zero = F.lit(0).cast("bigint")
        made = texts.where(F.col("c").isin(HASH, ID))
        level = _suffixes(first, [(w,) for w in range(WORDS)])
        for depth in (1, 2, 3):
            made = made.unionByName(level.select("c", "u", zero.alias("r1"), zero.alias("r2"), zero.alias("r3"), "id"))
            if depth == 3:
                break
            # Beginnings that too many suffixes share are few: fewer than suffixes by ``dense``.
            begin = F.shiftright("u", BITS * (WORDS - depth)).alias("begin")
            hot = cut(level.groupBy("c", begin).count().where(F.col("count") > dense).select("c", "begin"))
            if hot.isEmpty():
                break
            crowded = level.select("*", begin).join(hot, ["c", "begin"]).select("c", "value", "id")
            longer = [(c, o + (w,)) for c, o in ORDERS.items() if len(o) == depth for w in range(WORDS) if w not in o]
            level = cut(None if not longer else _union([_suffixes(crowded.where(F.col("c") == c), [o]) for c, o in longer]))
        made = cut(made)
        n = made.count()
        name = f"segment-{uuid.uuid4().hex}"
        files = max(1, math.ceil(n / CHUNK_ROWS), min(shuffle_width(spark), n // LEAST_ROWS))

        def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            whole = [b for b in batches if len(b)]
            pdf = pd.concat(whole, ignore_index=True) if whole else pd.DataFrame(columns=_COLUMNS)
            out = []
            for c, rows in pdf.groupby("c", sort=True):
                file = f"{c}-{uuid.uuid4().hex}"
                u = rows["u"].to_numpy(np.int64)
                self.save(f"{name}/{file}.u.npy", u)
                self.save(f"{name}/{file}.i.npy", rows["id"].to_numpy(np.int64))
                if c == HASH:
                    self.save(f"{name}/{file}.r.npy", rows[["r1", "r2", "r3"]].to_numpy(np.int64))
                out.append((c, u[0], u[-1], len(u), file))
            yield pd.DataFrame(out, columns=["c", "first", "last", "n", "file"])

        chunks = made.repartitionByRange(files, "c", "u", "id").sortWithinPartitions("c", "u", "id").mapInPandas(save, _CHUNKS).collect() if n else []
        return {"name": name, "rows": n, "chunks": [[r["c"], r["first"], r["last"], r["n"], r["file"]] for r in chunks]}


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _suffixes(texts: DataFrame, orders: list[tuple[int, ...]]) -> DataFrame:
    """``c, u, value, id``: the suffixes of ``value, id`` in each of ``orders``."""
    each = F.explode(F.array(*(F.struct(F.lit(CLASS_OF[o]).alias("c"), suffix_column(F.col("value"), o).alias("u")) for o in orders))).alias("x")
    return texts.select(each, "value", "id").select("x.c", "x.u", "value", "id")


class HistoryIndex:
    """Accepts batches of uploads in turn; ``accept`` returns the repeats in a batch and adds the batch to the history."""

    def __init__(self, spark: SparkSession, path: str, most: int = 6, dense: int = DENSE) -> None:
        if not 0 <= most <= 7:
            raise ValueError("most must be from 0 to 7")
        self.spark, self.folder, self.most, self.dense = spark, Folder(path), most, dense
        self.folder.check(spark)

    def accept(self, uploads: DataFrame) -> DataFrame:
        """``first_upload_id, upload_id`` of the batch's uploads that repeat an earlier one, in the history or in the batch.

        Equal 256-bit hashes, or perceptual hashes within ``most`` bits; of what an upload repeats the smallest id counts, and only smaller ids than its own.  Ids that were accepted
        before are left out and add nothing, whatever they carry now; so are null ids.  The result is stored before the batch counts as accepted, so it stays
        the same when it is read again.
        """
        self._merge()
        segments = self.folder.segments()
        marks = cut(upload_marks(uploads))
        ids = _rows(ID, F.col("upload_id"), F.col("upload_id"))
        if segments:
            asked = marks.select("upload_id").distinct().select(*ids)
            marks = cut(marks.join(self._search(asked, segments).select(F.col("id").alias("upload_id")), "upload_id", "left_anti"))
        real = marks.where("mark is not null")
        firsts = cut(real.groupBy("kind", "mark").agg(F.min("upload_id").alias("first_id")))
        word = lambda i: hex_to_long(F.substring("mark", 16 * i + 1, 16))
        hashes = firsts.where(F.col("kind") == HASH).select(*_rows(HASH, sortable(word(0)), F.col("first_id"), word(1), word(2), word(3)))
        values = firsts.where(F.col("kind") == 0).select(*_rows(CLASS_OF[(0,)], sortable(word(0)), F.col("first_id")))
        new = self.folder.write(hashes.unionByName(values).unionByName(marks.select("upload_id").distinct().select(*ids)), self.dense)
        turned = values.select(sortable(F.col("u")).alias("value"), "id")
        zero = F.lit(0).cast("bigint")
        asked = hashes.unionByName(_suffixes(turned, [(w,) for w in range(WORDS)]).select("c", "u", zero.alias("r1"), zero.alias("r2"), zero.alias("r3"), "id"))
        near = self._search(asked, [*segments, new]).groupBy("kind", F.col("id").alias("first_id")).agg(F.min("near").alias("near"))
        best = firsts.join(near, ["kind", "first_id"], "left").select("kind", "mark", F.least("first_id", F.coalesce("near", "first_id")).alias("first_id"))
        found = real.join(best, ["kind", "mark"]).where("first_id < upload_id")
        out = cut(found.groupBy("upload_id").agg(F.min("first_id").alias("first_upload_id")).select("first_upload_id", "upload_id"))
        self.folder.publish([*segments, {**new, "rank": 0}])
        return out

    def _search(self, asked: DataFrame, segments: list[dict]) -> DataFrame:
        """``kind, id, near`` of the queries that a record of smaller id covers; of ids, those that are there."""
        folder, most, dense = self.folder, self.most, self.dense
        kind_of = {CLASS_OF[(w,)]: 0 for w in range(WORDS)} | {HASH: HASH, ID: ID}

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [(s, folder.arrays(s)) for s in segments]
            for pdf in batches:
                for c, rows in pdf.groupby("c", sort=False):
                    u, ids = rows["u"].to_numpy(np.int64), rows["id"].to_numpy(np.int64)
                    best = np.full(len(u), NONE)
                    for segment, arrays in held:
                        if c in (HASH, ID):
                            rest = rows[["r1", "r2", "r3"]].to_numpy(np.int64)
                            best = np.minimum(best, _whole(arrays.get(c), folder.tails(segment, c) if c == HASH else None, u, rest, ids))
                        else:
                            best = np.minimum(best, earliest(arrays, ORDERS[c], u, u, ids, most, dense))
                    hit = best < NONE
                    yield pd.DataFrame({"kind": np.full(int(hit.sum()), kind_of[c], np.int32), "id": ids[hit], "near": best[hit]})

        # Queries that begin alike ask the same pages.
        return asked.repartitionByRange(shuffle_width(self.spark), "c", "u", "id").mapInPandas(search, "kind int, id bigint, near bigint")

    def _merge(self) -> None:
        """While the newest two segments are of one rank they become one."""
        segments = self.folder.segments()
        merged = list(segments)
        while len(merged) > 1 and merged[-2]["rank"] == merged[-1]["rank"]:
            a, b = merged.pop(-2), merged.pop()
            rows = self.folder.rows(self.spark, [a, b])
            # Of a text in both the smallest id counts.
            once = rows.groupBy("c", "u", "r1", "r2", "r3").agg(F.min("id").alias("id")).select(*_COLUMNS)
            merged.append({**self.folder.write(once, self.dense), "rank": a["rank"] + 1})
        if len(merged) < len(segments):
            self.folder.publish(merged)


def _rows(c: int, u, id_, *rest):  # noqa: ANN001, ANN002, ANN202
    rest = rest or (F.lit(0).cast("bigint"),) * 3
    return F.lit(c).cast("int").alias("c"), u.alias("u"), *(r.alias(n) for r, n in zip(rest, ("r1", "r2", "r3"))), id_.cast("bigint").alias("id")


def _whole(array: SuffixArray | None, tails: list[np.ndarray] | None, u: np.ndarray, rest: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of a record that equals the query, below its own; of ids, their own."""
    best = np.full(len(u), NONE)
    if array is None:
        return best
    lo, hi = array.find(u, "left"), array.find(u, "right")
    if tails is None:
        return np.where(hi > lo, ids, best)
    n = hi - lo
    who = np.repeat(np.arange(len(u)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    found = array.take(at)[1]
    chunk = np.searchsorted(array.starts, at, side="right") - 1
    same = np.zeros(len(at), bool)
    for c in np.unique(chunk):
        rows = np.flatnonzero(chunk == c)
        same[rows] = (tails[c][at[rows] - array.starts[c]] == rest[who[rows]]).all(1)
    good = same & (found < ids[who])
    np.minimum.at(best, who[good], found[good])
    return best


def find_repeats(uploads: DataFrame, most: int = 6, steps: int = 3, dense: int = DENSE) -> DataFrame:
    """``first_upload_id, upload_id`` of every upload that repeats an earlier one, with the smallest upload_id it repeats.

    Reads ``upload_id``, ``batch_id``, ``upload_hash`` and ``phash``.  Two uploads are repeats if their hashes are one 256-bit value or their perceptual
    hashes differ in at most ``most`` bits; earlier means a smaller id.  Rows without an id are left out.  Of rows that share an id the one
    of the smallest batch counts; a null batch counts as the first.  Equal values collapse before any search, so any share of all uploads may
    carry one value.

    The uploads are accepted by a ``HistoryIndex`` in ``steps`` consecutive parts by id, each asked against the segments of those before; the number changes no result.
    """
    spark = uploads.sparkSession
    used = cut(uploads.select("upload_id", "batch_id", "upload_hash", "phash"))
    bounds = used.where("upload_id is not null").approxQuantile("upload_id", [i / steps for i in range(1, steps)], 0.01) if steps > 1 else []
    edges = [None, *sorted({int(b) for b in bounds}), None]
    index = HistoryIndex(spark, f"{checkpoint_folder(spark)}/history-{uuid.uuid4().hex}", most, dense)
    out = None
    for low, high in zip(edges, edges[1:]):
        part = used
        if low is not None:
            part = part.where(F.col("upload_id") > low)
        if high is not None:
            part = part.where(F.col("upload_id") <= high)
        found = index.accept(part)
        out = found if out is None else out.unionByName(found)
    index.folder.remove()
    return out
