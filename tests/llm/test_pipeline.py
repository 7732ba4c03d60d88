"""The pipeline on a small table against its stages' plain versions."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from adjudica.llm import tokens

from .test_operators import plain_groups, plain_hits, plain_lines  # noqa: F401


@pytest.fixture(scope="module")
def sf_dir(docs, spark, rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[1][1].split()[:25]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_in_order(spark, docs, sf_dir, rows):
    now, columns = docs, docs.columns
    texts = {k: t for k, t, *_ in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, now, sf_dir)
        assert made.columns == columns
        got = {r.doc_id: r.text for r in made.collect()}
        before = [(k, t) for k, t in texts.items()]
        if name == "quality_rules":
            assert 0 < len(got) < len(texts) and all(len((texts[k] or "").split()) >= 20 for k in got)
        elif name == "line_dedup":
            import hashlib

            want = plain_lines(before)
            assert set(got) == set(texts) and all(hashlib.sha256(got[k].encode()).hexdigest() == want[k][2] for k in got)
        elif name == "near_duplicates":
            want = plain_groups(before)
            assert set(got) == {k for k, (_, g, _) in want.items() if g == k}
        else:
            hits = plain_hits(before, [(1, " ".join(rows[1][1].split()[:25]))])
            assert all(got[k] == t for k, t in before if not hits[k][1]) and any(h[1] for h in hits.values())
            assert not any(h[1] for h in plain_hits(list(got.items()), [(1, " ".join(rows[1][1].split()[:25]))]).values())
        now, texts = spark.createDataFrame(made.collect(), docs.schema), got
    pieces = collections.defaultdict(list)
    for p in corpus_pipeline.STAGES[-1][1](spark, now, sf_dir).collect():
        pieces[p.doc_id].append(p)
    own = tokens.Encoder(tokens.default_path())
    assert set(pieces) == set(texts)
    for k, ps in pieces.items():
        raw = b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start))
        assert raw == own.ids_bytes(texts[k] or "") + np.array([0], "<u4").tobytes()
        assert all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in ps)


def test_run(spark, docs, sf_dir):
    """run() gives what the stages give one after the other, each on the rows that the one before gave."""
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), docs.schema)
    own = tokens.Encoder(tokens.default_path())
    want = {r.doc_id: own.ids_bytes(r.text or "") + np.array([0], "<u4").tobytes() for r in now.collect()}
    got = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, sf_dir).collect():
        got[p.doc_id].append(p)
    assert {k: b"".join(bytes(p.ids) for p in sorted(ps, key=lambda p: p.start)) for k, ps in got.items()} == want


def test_stages_on_odd_tables(spark, odd, none, sf_dir):
    """Values, not counts: what each stage keeps of null and repeated ids, null texts and columns of clashing names."""
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
    rows = sorted(map(tuple, odd.collect()), key=str)
    assert stages["quality_rules"](spark, odd, sf_dir).collect() == []  # all are of under 20 words
    for name in ("line_dedup", "decontamination"):
        got = stages[name](spark, odd, sf_dir)
        assert got.columns == odd.columns and sorted(((r[0], r[1] or "", *r[2:]) for r in got.collect()), key=str) == sorted(((r[0], r[1] or "", *r[2:]) for r in rows), key=str)
    kept = sorted(map(tuple, stages["near_duplicates"](spark, odd, sf_dir).collect()), key=str)
    assert kept == sorted({r for r in rows if r[0] == 5} | {r for r in rows if r[0] != 5}, key=str)
    own, pieces = tokens.Encoder(tokens.default_path()), stages["packing"](spark, odd, sf_dir).collect()
    sizes = sorted((str(r[0]), len(own.ids_bytes(r[1] or "")) // 4 + 1) for r in rows)
    assert sorted((str(p.doc_id), p.doc_tokens) for p in pieces if p.start == 0) == sizes
    assert sum(p.length for p in pieces) == sum(n for _, n in sizes) and all(len(p.ids) == 4 * p.length for p in pieces)
