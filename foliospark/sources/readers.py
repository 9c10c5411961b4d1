"""Sources: uploads, images, stored responses, and adapters for readers of text that run outside."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.operators.nested import find_response
from foliospark.operators.quality import upload_status
from foliospark.schemas import META, OCR_DOCUMENT, TOKEN

TOKEN_ROWS = f"doc_id bigint, page int, idx int, {TOKEN}"
CELL_ROWS = "doc_id bigint, page int, cell int, bbox array<int>, text string, conf double"


def read_uploads(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """``path, mime_type, length, status, sha256, content`` of files; those not taken keep their row and have a status."""
    files = spark.read.format("binaryFile").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(ending == "png", "image/png").when(ending.isin("jpg", "jpeg"), "image/jpeg").when(ending == "pdf", "application/pdf")
    return files.select("path", mime.alias("mime_type"), "length", upload_status(mime, F.col("length"), config).alias("status"), F.sha2("content", 256).alias("sha256"), "content")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files, decoded by Spark."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of tokens as JSON, one a file or a line."""
    return spark.read.schema(OCR_DOCUMENT).option("multiLine", True).json(path)


def stored_documents(responses: DataFrame, meta: bool = False) -> DataFrame:
    """``doc_id, fullText`` of stored JSON responses, under any wrapping, with ``meta`` if asked for; unreadable ones give no row.

    Boxes given as four numbers become four points.  A repeated id gives one row.
    """
    schema = "doc_id bigint, fullText string, meta string"

    def unwrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            out = []
            for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if (doc := find_response(p)) is not None:
                    tokens = doc.get("fullText") or []
                    out.append((i, json.dumps([_four_points(t) for t in (tokens if isinstance(tokens, list) else [tokens]) if isinstance(t, dict) and t], ensure_ascii=False), json.dumps(doc["meta"]) if meta and isinstance(doc.get("meta"), dict) else None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))], ["doc_id", "fullText", "meta"])

    texts = responses.where("response_id is not null and payload is not null").select("response_id", "payload").mapInArrow(unwrap, schema)
    once = texts.groupBy("doc_id").agg(F.min(F.struct("fullText", "meta") if meta else F.struct("fullText")).alias("x"))
    tokens = F.from_json("x.fullText", OCR_DOCUMENT.split("fullText ", 1)[1]).alias("fullText")
    return once.select("doc_id", tokens, *([F.from_json("x.meta", f"struct<{META}>").alias("meta")] if meta else []))


def _four_points(token: dict) -> dict:
    box = token.get("bbox")
    if isinstance(box, list) and len(box) == 4 and all(isinstance(v, (int, float)) for v in box):
        l, t, r, b = box
        token = token | {"bbox": [[l, t], [r, t], [r, b], [l, b]]}
    return {k: v for k, v in token.items() if k in ("text", "bbox", "conf", "confidence", "handwritten", "hw_score")}


def apply_adapter(pages: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str = TOKEN_ROWS) -> DataFrame:
    """Rows of a reader that runs in Python workers: ``load`` makes it once a worker, it turns a batch of pages into rows of ``schema``.

    Rasterisers, text recognisers, table recognisers and re-readers of handwriting plug in here.  Filter pages before: nothing is pushed through.
    """
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The module of the worker, not a copy that came with the task.
        from foliospark.sources import readers

        reader = readers.loaded(key, load)
        for pdf in batches:
            yield reader(pdf)

    return pages.mapInPandas(run, schema)


_LOADED: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def loaded(key: str, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The reader of ``key``, loaded once in a worker; only the last one used is kept."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = load()
    return _LOADED[key]


def first_pages(pages: DataFrame, config: Config = Config(), page: str = "page") -> DataFrame:
    """Pages before the most that a document is read of; filter before an adapter, through which nothing is pushed."""
    return pages.where(F.col(page) < config.max_pages)


def documents_of(tokens: DataFrame) -> DataFrame:
    """Documents from token rows, tokens in order of page and place."""
    item = F.struct("page", "idx", "text", "bbox", "conf", "confidence", "handwritten", "hw_score")
    grouped = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("t"))
    return grouped.select("doc_id", F.transform("t", lambda x: F.struct(*(x[c].alias(c) for c in ("text", "bbox", "conf", "confidence", "handwritten", "hw_score")))).alias("fullText"))
