"""Image metrics, quality gate, warnings and hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.functions.scalars import let
from foliospark.operators.clusters import density_labels

METRICS = "focus double, glare double, skew_deg double, phash string"


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of a blue-green-red image."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return a[..., 0] if channels == 1 else a[..., 0] * 0.114 + a[..., 1] * 0.587 + a[..., 2] * 0.299


def focus_score(g: np.ndarray) -> float:
    """Variance of the Laplacian, borders reflected."""
    p = np.pad(g, 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g).var())


def glare_ratio(g: np.ndarray) -> float:
    """Share of pixels above 250."""
    return float((g > 250).mean()) if g.size else 0.0


def skew_angle(g: np.ndarray) -> float:
    """Angle of the least rectangle around pixels darker than 250, from -45 to 45 degrees; 0 without any."""
    y, x = np.nonzero(g < 250)
    if len(x) < 3:
        return 0.0
    # Only each row's ends can be corners of the hull.
    order = np.lexsort((x, y))
    y, x = y[order], x[order]
    ends = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
    pts = sorted({*zip(x[ends].tolist(), y[ends].tolist()), *zip(x[np.append(ends[1:] - 1, len(x) - 1)].tolist(), y[np.append(ends[1:] - 1, len(x) - 1)].tolist())})
    hull = _hull(pts)
    if len(hull) < 3:
        return 0.0
    h = np.array(hull, float)
    edges = np.roll(h, -1, 0) - h
    best, angle = np.inf, 0.0
    for a in np.unique(np.round(np.arctan2(edges[:, 1], edges[:, 0]) % (np.pi / 2), 9)):
        c, s = np.cos(a), np.sin(a)
        u, v = h @ (c, s), h @ (-s, c)
        size = np.ptp(u) * np.ptp(v)
        if size < best - 1e-9:
            best, angle = size, np.degrees(a)
    return float(angle - 90 if angle > 45 else angle)


def _hull(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    def half(seq: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(points[::-1])


def perceptual_hash(g: np.ndarray) -> str:
    """64 bits in hex: signs of the low cosine frequencies against their median, on a 32 by 32 reduction."""
    rows, cols = (np.array_split(np.arange(n), 32) if n >= 32 else [np.array([i * n // 32]) for i in range(32)] for n in g.shape)
    small = np.array([[g[np.ix_(r, c)].mean() for c in cols] for r in rows])
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ small @ basis.T)[:8, :8].ravel()
    return f"{int(''.join('1' if b else '0' for b in low > np.median(low)), 2):016x}"


def measure_images(images: DataFrame, image: str = "image") -> DataFrame:
    """Metrics and perceptual hash of rows with Spark's image struct; images that can't be read give nulls."""
    keep = [c for c in images.columns if c != image]
    src = images.select(*keep, *(F.col(f"{image}.{c}").alias(f"_{c}") for c in ("data", "height", "width", "nChannels")))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for d, h, w, n in zip(pdf["_data"], pdf["_height"], pdf["_width"], pdf["_nChannels"]):
                g = gray(bytes(d), int(h), int(w), int(n)) if d is not None and len(d) == h * w * n and h * w > 0 else None
                out.append((None,) * 4 if g is None else (focus_score(g), glare_ratio(g), skew_angle(g), perceptual_hash(g)))
            yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame(out, columns=["focus", "glare", "skew_deg", "phash"])], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name in keep)
    return src.mapInPandas(measure, f"{schema}, {METRICS}" if schema else METRICS)


def gate(mime: Column, focus: Column, glare: Column, width: Column, height: Column, config: Config = Config()) -> Column:
    """struct(ok, reject): thresholds are milder for PDF; a PDF is never rejected."""
    c, pdf = config, F.coalesce(mime == "application/pdf", F.lit(False))
    least = lambda strict, mild: F.when(pdf, mild).otherwise(strict)
    ok = (F.greatest(width, height) >= least(c.min_edge, c.min_edge_pdf)) & (focus >= least(c.min_focus, c.min_focus_pdf)) & (glare <= least(c.max_glare, c.max_glare_pdf))
    return let(F.coalesce(ok, F.lit(False)), lambda x: F.struct(x.alias("ok"), (~x & ~pdf & F.lit(c.reject_if_bad_quality)).alias("reject")))


def upload_status(mime: Column, size: Column, config: Config = Config()) -> Column:
    """ok, or why an upload isn't taken: unsupported type or too large."""
    known = mime.isin("image/png", "image/jpeg", "application/pdf")
    return F.when(~F.coalesce(known, F.lit(False)), "unsupported").when(size > config.max_upload_mb * 1024 * 1024, "too_large").otherwise("ok")


def gated(uploads: DataFrame, n_tokens: Column | None = None, config: Config = Config()) -> DataFrame:
    """``uploads`` with ``outcome``, ``warnings`` and ``meta``: what is answered before anything is read.

    ``outcome`` is read, or why it isn't: unsupported, too_large, bad_quality, or no_text where the first page has no tokens.  A rejected image is answered in short: no
    hashes, no confidence, one warning.  A poor PDF is read all the same, with a warning.
    Reads ``mime_type, size_bytes, focus, glare, res_width, res_height, ocr_confidence, upload_hash, phash``.
    """
    status, g = upload_status(F.col("mime_type"), F.col("size_bytes"), config), gate(F.col("mime_type"), F.col("focus"), F.col("glare"), F.col("res_width"), F.col("res_height"), config)
    outcome = F.when(status != "ok", status).when(g["reject"], "bad_quality").when((n_tokens if n_tokens is not None else F.lit(1)) == 0, "no_text").otherwise("read")
    d = uploads.withColumn("_ok", g["ok"]).withColumn("outcome", outcome)
    short, read = F.col("outcome") == "bad_quality", F.col("outcome") == "read"
    one = lambda code, field, score: F.array(F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), score.cast("double").alias("score")))
    none = F.lit(None).cast("double")
    warned = F.when(short, one("BAD_QUALITY", None, none)).when(read & ~F.col("_ok") & (F.col("mime_type") == "application/pdf"), one("LOW_QUALITY_PDF", "page_1", F.col("focus"))).otherwise(F.slice(one("", None, none), 1, 0))
    meta = F.struct(
        F.when(short, F.lit(0.0)).otherwise(F.col("ocr_confidence")).alias("ocrConfidence"), F.struct("focus", "glare", F.array("res_width", "res_height").alias("resolution")).alias("quality"), F.lit(False).alias("duplicateLikely"),
        *(F.when(short, F.lit("")).otherwise(F.col(c)).alias(n) for c, n in (("upload_hash", "uploadHash"), ("phash", "phash"))),
    )
    return d.withColumn("warnings", warned).withColumn("meta", F.when(short | read, meta)).drop("_ok")


def warnings(focus: Column, glare: Column, number_confidence: Column, config: Config = Config()) -> Column:
    """Array of struct(code, field, score) of what is doubtful about a document."""
    w = lambda test, code, field, score: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(field).cast("string").alias("field"), score.cast("double").alias("score")))
    found = F.array(
        w(focus < config.min_focus, "LOW_FOCUS", None, focus), w(glare > config.max_glare, "HIGH_GLARE", None, glare), w(number_confidence < config.min_field_confidence, "LOW_CONF_FIELD", "invoice.number", number_confidence)
    )
    return F.filter(found, lambda x: x.isNotNull())


def line_warnings(lines: Column, config: Config = Config()) -> Column:
    """Warnings of an array of lines with ``qty_conf`` and ``price_conf``, by place."""
    one = lambda c, i, name: F.when(c < config.min_line_confidence, F.struct(F.lit("LOW_CONF_FIELD").alias("code"), F.format_string("lines[%d]." + name, i).alias("field"), c.alias("score")))
    pairs = F.flatten(F.transform(lines, lambda x, i: F.array(one(x["qty_conf"], i, "qty"), one(x["price_conf"], i, "unitPrice"))))
    return F.filter(pairs, lambda x: x.isNotNull())


def stroke_features(g: np.ndarray) -> tuple[float, float, float]:
    """(edge density, spread of stroke widths, irregularity) of a grey crop; zeros for one under 20 pixels a side.

    Edges are steps of brightness above 100 a pixel.  A stroke's width at a dark pixel is its distance, in steps of a pixel, to the nearest light one; dark is what Otsu's threshold
    says.  Irregularity is the mean over connected dark shapes of 1 less circularity, from pixels and boundary pixels.
    """
    if g.shape[0] < 20 or g.shape[1] < 20:
        return 0.0, 0.0, 0.0
    dy, dx = np.gradient(g.astype(float))
    density = float((np.hypot(dx, dy) * 2 > 100).mean())
    counts = np.bincount(np.clip(g, 0, 255).astype(int).ravel(), minlength=256).astype(float)
    weight, sums = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * weight / weight[-1] - sums) ** 2 / (weight * (weight[-1] - weight))
    dark = g <= int(np.nanargmax(np.where(np.isfinite(between), between, -1.0)))
    width, left, depth = np.zeros(g.shape), dark.copy(), 0
    edge_of = lambda m: m & ~(np.pad(m, 1)[:-2, 1:-1] & np.pad(m, 1)[2:, 1:-1] & np.pad(m, 1)[1:-1, :-2] & np.pad(m, 1)[1:-1, 2:])
    while left.any():
        depth += 1
        rim = edge_of(left)
        width[rim] = depth
        left &= ~rim
    spread_ = float(width[dark].std()) if dark.any() else 0.0
    y, x = np.nonzero(dark)
    shapes = density_labels(x.astype(float), y.astype(float), 1.5)
    rim = edge_of(dark)[y, x]
    kept = [(float((shapes == s).sum()), float(rim[shapes == s].sum())) for s in range(int(shapes.max(initial=-1)) + 1)]
    odd = [1 - min(1.0, 4 * np.pi * a / (p * p)) for a, p in kept if p > 5]
    return density, spread_, float(np.sum(odd) / len(kept)) if kept else 0.0


def handwriting_score(edge_density: Column, stroke_std: Column, irregularity: Column) -> Column:
    """0 to 1 from three features of a crop."""
    return F.when(edge_density > 0.15, 0.3).otherwise(0.0) + F.when(stroke_std > 2, 0.4).otherwise(0.0) + F.when(irregularity > 0.5, 0.3).otherwise(0.0)


def better_reading(text: Column, conf: Column, other: Column, other_conf: Column, score: Column, threshold: float = 0.6) -> Column:
    """struct(text, conf, handwritten): another reading replaces the first where the crop looks handwritten and it is surer."""
    use = F.coalesce((score > threshold) & (other_conf > conf), F.lit(False))
    return F.struct(F.when(use, other).otherwise(text).alias("text"), F.when(use, other_conf).otherwise(conf).alias("conf"), use.alias("handwritten"))


def same_content(uploads: DataFrame, key: str, content: Column) -> DataFrame:
    """``sha, n, first_key`` of contents that occur more than once."""
    return uploads.select(F.sha2(content, 256).alias("sha"), key).groupBy("sha").agg(F.count("*").alias("n"), F.min(key).alias("first_key")).where("n > 1")
