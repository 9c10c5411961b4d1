"""Repeats of uploads against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import history as H
from foliospark.llm.history_store import HistoryIndex, find_repeats

SCHEMA = "upload_id bigint, batch_id int, upload_hash string, phash string, mark string, first_id bigint"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA)


def brute(rows, most=6):
    once = {}
    for u, b, h, p in rows:
        if u is not None:
            once[u] = min(once.get(u, (10**9, "~", "~")), ((b if b is not None else -1), h or "", p or ""))
    def value(x, n):
        t = (x or "").lower().replace("sha256:", "").replace("0x", "").strip()
        return int(t, 16) if t and int(t, 16) else None
    vals = {u: (value(x[1], 64), value(x[2], 16)) for u, x in once.items()}
    out = {}
    for u, (h, p) in vals.items():
        before = [v for v, (g, q) in vals.items() if v < u and ((h is not None and g == h) or (p is not None and q is not None and bin(p ^ q).count("1") <= most))]
        if before:
            out[u] = min(before)
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows, seen = [], []
    for u in range(1, 700):
        h, p = f"{rng.getrandbits(256):064x}", rng.getrandbits(64)
        if seen and rng.random() < 0.4:
            h0, p0 = rng.choice(seen)
            if rng.random() < 0.5:
                h = h0
            for _ in range(rng.randint(0, 9)):
                p0 ^= 1 << rng.randrange(64)
            p = p0
        seen.append((h, p))
        style = rng.randrange(6)
        hs = [h, h.upper(), "sha256:" + h, " " + h + " ", None, ""][style]
        ps = [f"{p:016x}", f"{p:016X}", f"0x{p:016x}", f"{p:x}", f"{p:016x}", None][rng.randrange(6)]
        rows.append((u, u // 50, hs, ps))
        if rng.random() < 0.05:
            rows.append((u, u // 50 + 1, hs, ps))
    got = {r["upload_id"]: r["first_upload_id"] for r in find_repeats(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    z = "0" * 64
    rows = [(1, 1, z, "0" * 16), (2, 1, z, "0" * 16), (3, 1, None, None), (4, 1, "", ""), (5, None, "zz", "xyz"), (None, 1, "ab" * 32, None), (6, 1, "ab" * 32, "f" * 16), (7, 2, "AB" * 32, "f" * 10_000)]
    assert {tuple(r) for r in find_repeats(frame(spark, rows)).collect()} == {(6, 7)}
    assert find_repeats(frame(spark, rows).where("false")).count() == 0


def test_a_hot_value_and_hot_symbols(spark):
    """A third of all uploads carry one value; the other values share their first symbol."""
    rng = np.random.default_rng(1)
    low = rng.integers(0, 2**48, 6000, dtype=np.uint64)
    rows = [(i, i // 500, None, f"{int(x) | 0xABCD << 48:016x}") for i, x in enumerate(low)] + [(10_000 + i, 20, None, "abcd111122223333") for i in range(3000)]
    got = {r["upload_id"]: r["first_upload_id"] for r in find_repeats(frame(spark, rows)).collect()}
    v = np.array([int(r[3], 16) for r in rows], np.uint64)
    ids = np.array([r[0] for r in rows])
    want = {}
    for i in range(len(v)):
        near = ids[(np.bitwise_count(v ^ v[i]) <= 6) & (ids < ids[i])]
        if len(near):
            want[int(ids[i])] = int(near.min())
    assert got == want


def near_of(v, ids, most=6):
    want = {}
    for i in range(len(v)):
        near = ids[(np.bitwise_count(v ^ v[i]) <= most) & (ids < ids[i])]
        if len(near):
            want[int(ids[i])] = int(near.min())
    return want


@pytest.mark.parametrize("shared", [0, 16, 32, 48])
def test_longer_matches_where_beginnings_are_shared(spark, tmp_path, shared):
    """Hashes that share one, two or three symbols, so many that only longer matches are looked up."""
    rng = np.random.default_rng(shared)
    v = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64) >> np.uint64(shared) if shared else rng.integers(0, 2**63, 900, dtype=np.uint64))
    for _ in range(2):
        v = np.unique(np.concatenate([v, v[:200] ^ (np.uint64(1) << rng.integers(0, 64 - shared, 200, dtype=np.uint64))]))
    v |= np.uint64(0xABCD12345678 << 16 >> (64 - shared) << (64 - shared) if shared else 0)
    order = rng.permutation(len(v))
    v, ids = v[order], np.arange(len(v))
    rows = [(int(i), int(i) // 300, None, f"{int(x):016x}") for i, x in zip(ids, v) if x]
    got = {}
    index = HistoryIndex(spark, f"{tmp_path}/index", dense=20)
    for b in range(0, len(rows), 500):
        got |= {r["upload_id"]: r["first_upload_id"] for r in index.accept(frame(spark, rows[b : b + 500])).collect()}
    held = ids[v != 0]
    assert got == near_of(v[held], held)
    classes = {c for s in index.folder.segments() for c, *_ in s["chunks"]}
    assert (max(len(H.ORDERS[c]) for c in classes if c in H.ORDERS) > 1) == (shared > 0)


def test_suffixes_are_reordered_as_they_are_written(spark):
    v = np.random.default_rng(5).integers(0, 2**63, 50, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(int(x),) for x in v], "v bigint")
    one = np.array([r[0] for r in df.select(H.suffix_column(F.col("v"), (2,))).collect()])
    for order in ((0,), (2, 0), (2, 3, 1)):
        assert (np.array([r[0] for r in df.select(H.suffix_column(F.col("v"), order)).collect()]) == H.reorder(one, (2,), order)).all()


def test_bounds(spark, tmp_path):
    with pytest.raises(ValueError):
        HistoryIndex(spark, str(tmp_path), 8)


def batches_of(spark):
    uploads = spark.read.parquet("/root/testdata/sf0.01/uploads.parquet").select("upload_id", "batch_id", "upload_hash", "phash").cache()
    numbers = sorted(r[0] for r in uploads.select("batch_id").distinct().collect())[:6]
    known = uploads.where(F.col("batch_id").isin(numbers))
    return known, [known.where(F.col("batch_id") == b) for b in numbers]


def test_batches_in_turn_find_what_the_whole_does(spark, tmp_path):
    known, batches = batches_of(spark)
    index, got = HistoryIndex(spark, f"file://{tmp_path}/index"), set()
    for batch in batches:
        got |= {tuple(r) for r in index.accept(batch).collect()}
    for steps in (1, 3):
        assert got == {tuple(r) for r in find_repeats(known, steps=steps).collect()} and got
    # Six batches are held in three segments at most, and nothing else is left on disk.
    segments = index.folder.segments()
    assert len(segments) <= 3 and sum(1 for x in (tmp_path / "index").iterdir() if x.is_dir()) == len(segments)
    again = HistoryIndex(spark, f"{tmp_path}/index").accept(batches[0])
    assert again.count() == 0, "what was accepted before is no new repeat"
    assert HistoryIndex(spark, f"{tmp_path}/other").accept(known.where("false")).count() == 0


def test_a_batch_that_failed_leaves_nothing_behind(spark, tmp_path, monkeypatch):
    index = HistoryIndex(spark, f"{tmp_path}/index")
    index.accept(frame(spark, [(1, 1, "ab" * 32, None)])).count()
    dead = frame(spark, [(2, 2, "cd" * 32, "00000000ffffffff")])
    with monkeypatch.context() as m:
        m.setattr(index.folder, "publish", lambda segments: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.accept(dead)
    assert index.accept(frame(spark, [(3, 3, "cd" * 32, "00000000fffffffe")])).count() == 0, "upload 2 was never accepted"
    assert {tuple(r) for r in index.accept(frame(spark, [(4, 4, "CD" * 32, None)])).collect()} == {(3, 4)}


def test_a_redelivered_upload_adds_nothing(spark, tmp_path):
    index = HistoryIndex(spark, f"{tmp_path}/index")
    index.accept(frame(spark, [(1, 1, "ab" * 32, None)])).count()
    index.accept(frame(spark, [(1, 2, "cd" * 32, "00000000ffffffff"), (5, 2, None, None)])).count()
    assert index.accept(frame(spark, [(9, 3, "cd" * 32, "00000000ffffffff")])).count() == 0


def test_a_batch_reads_in_proportion_to_its_size():
    """Positions looked up for one batch don't grow with the history; what is compared grows with the share of records that begin alike, a 65536th each."""
    rng = np.random.default_rng(0)
    asked = rng.integers(-(2**63), 2**63, 200)
    seen = []
    for n in (20_000, 200_000):
        u = np.sort(rng.integers(-(2**63), 2**63, n))
        a = H.SuffixArray([(int(u[i]), min(50_000, n - i), lambda u=u, i=i: (u[i : i + 50_000], np.arange(i, min(i + 50_000, len(u))))) for i in range(0, n, 50_000)])
        H.earliest({0: a}, (0,), asked, asked, np.full(200, 2**62), 6)
        seen.append((a.looked_up, a.compared))
    assert seen[0][0] == seen[1][0] == 2 * 17 * 200 and seen[1][1] < 200 * 17 * 200_000 / 65536 * 1.2
