"""Search, archives and the pipeline."""

import base64
import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veltra.llm import registry, topk, warc


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(registry.ORACLE[name])
    df = registry.QUERIES[name](spark, sf_dir).select(*want.columns)
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


def brute(rows, k, step):
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % step == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("tile, query_tile, block", [(1 << 16, 512, 256), (40, 7, 8)])
def test_top_k(spark, monkeypatch, tile, query_tile, block):
    for name, value in (("TILE", tile), ("QUERY_TILE", query_tile), ("BLOCK", block), ("SUMMARIES", 1 << 14 if block == 256 else 10)):
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(6)
    rows = [(i, [rnd.choice([-1.5, -0.3, 0.0, 0.02, 0.4, 2.0]) for _ in range(5)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(400, None), (420, []), (440, [1.0, None, 1.0, 1.0, 1.0]), (460, [float("nan")] * 5), (480, [float("inf")] * 5), (None, [1.0] * 5), (500, [1.0, 2.0]), (520, [1e9] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=6).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, 6, 20)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_are_skipped():
    rng = np.random.default_rng(0)
    centres = rng.integers(-60, 60, (12, 16))
    vectors = (centres[rng.integers(0, 12, 6000)] + rng.integers(-3, 4, (6000, 16))).astype(np.int64)
    q, i, s, opened = topk.search_blocks(np.arange(20), vectors[:20], np.full(20, topk.LOW), topk.blocks_of(np.arange(6000), vectors), 5)
    scores = vectors[:20] @ vectors.T
    for r in range(20):
        order = sorted((-scores[r, j], j) for j in range(6000) if j != r)[:5]
        assert [(-a, b) for a, b in order] == list(zip(s[q == r], i[q == r]))
    assert opened < 0.7 * 20 * 24


PAGES = [(5, "http://a/", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, None, None), (4, "http://c/\r\nX", ""), (7, "http://d/é", "ünïcode\r\n\r\nWARC/1.1"), (2, "http://b/", "<p>same</p>"), (11, "u", "z" * 500_000), (None, "n", "<p>same</p>"), (None, "m", "only null")]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("size", F.lit(1)).repartition(2)
    bundles = warc.write_bundles(pages, frame_bytes=1000, bundle_bytes=200)
    out = warc.read_records(bundles).collect()
    payload = lambda h: (h or "").encode()
    want = []
    for i, _, h in PAGES:
        first = min((j for j, _, g in PAGES if payload(g) == payload(h) and j is not None), default=None)
        own = first is None or i == first
        want.append((i, len(payload(h)), base64.b32encode(hashlib.sha1(payload(h)).digest()).decode(), "response" if own else "revisit", None if own else first))
    assert sorted(map(repr, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out))) == sorted(map(repr, want))
    assert {r.html for r in out if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    assert [r.html for r in warc.find_records(bundles, [11]).collect()] == ["z" * 500_000]
    assert warc.read_records(warc.write_bundles(pages.limit(0))).count() == 0


def test_bundle_is_a_seekable_zstandard_file():
    import zstandard

    w = warc.BundleWriter(frame_bytes=100)
    records = [warc.warc_record(i, "u", b"x" * 60, 60, "D", None) for i in range(5)]
    for i, r in enumerate(records):
        w.add(i, r)
    raw = w.close()
    n, _, magic = struct.unpack("<IBI", raw[-9:])
    assert magic == warc.SEEK_MAGIC and n == 5
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
        assert f.read() == b"".join(records)
    reader = warc.BundleReader(raw)
    for (_, _, frame, offset, length), r in zip(w.entries, records):
        assert reader.record(frame, offset, length) == r
    with pytest.raises(ValueError):
        warc.BundleReader(raw[:-1])


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs
    from veltra.llm._util import materialize

    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, before, sf_dir), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns and 0 < out.count()
        assert out.join(before, "doc_id", "left_anti").count() == 0
        before = out
    assert before.where("not decoded").count() == 0
    extra = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    kept = corpus_pipeline.near_duplicates(spark, extra, sf_dir)
    assert kept.where("doc_id is not null").count() == kept.where("doc_id is not null").select("doc_id").distinct().count()
    assert kept.where("doc_id is null").count() == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_duplicate_stage_against_brute_force(spark):
    rnd = random.Random(21)
    text = lambda n: [f"w{rnd.randrange(400)}" for _ in range(n)]
    rows = []
    for family in range(4):
        base = text(120)
        for _ in range(12):
            copy = list(base)
            for _ in range(rnd.randrange(9)):
                copy[rnd.randrange(120)] = f"edit{rnd.randrange(10**6)}"
            rows.append(" ".join(copy))
        rows += [" ".join(base), " ".join(base).upper()]
    rows += [" ".join(text(rnd.randrange(1, 60))) for _ in range(30)] + ["", "  ", None, " ".join(text(30_000))]
    rnd.shuffle(rows)
    table = [(i if i % 17 else None, t, "x") for i, t in enumerate(rows)]
    table += [table[5], (5, "another text of the same id", "x")]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4)) if w}
    sets, label = [shingles(t) for _, t, _ in table], list(range(len(table)))
    for i in range(len(table)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    df = spark.createDataFrame(table, "doc_id long, text string, _th string")
    got = corpus_pipeline.near_duplicates(spark, df, "")
    kept = sorted(map(repr, (tuple(r) for r in got.collect())))
    hashes = [r[0] for r in df.select(F.xxhash64("text")).collect()]
    want = set()
    for x in set(label):
        group = [i for i in range(len(table)) if label[i] == x]
        want.add(repr(table[min(group, key=lambda i: (table[i][0] is None, table[i][0] or 0, hashes[i]))]))
    assert kept == sorted(want) and got.columns == df.columns
