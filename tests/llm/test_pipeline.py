"""The pipeline against a plain version, stage by stage, on the small tables and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tallyframe.llm import linededup, packing, quality, secretscan, simhash

from .test_pairs import brute_fingerprint, union


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(f(spark, out[-1], sf_small), "test"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "secret scans", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_quality_stage(spark, stages, sf_small):
    labels = spark.read.parquet(f"{sf_small}/labels.parquet")
    kept = {r["doc_id"] for r in quality.judged(stages[0], labels).where("kept").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert after == {d: r for d, r in before.items() if d in kept} and 0 < len(after) < len(before)


def test_line_stage(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert before.keys() == after.keys()
    seen, t = [], linededup.THRESHOLD
    lines = [(d, n, line.strip()) for d in sorted(before) for n, line in enumerate(before[d]["text"].split("\n")) if len(line.strip()) >= 24 or any(c.isalnum() for c in line)]
    pairs = []
    by = defaultdict(list)
    for i, (_, _, s) in enumerate(lines):
        for size in range(len(s) - t, len(s) + t + 1):
            pairs += [(j, i) for j in by[size] if lines[j][2] == s or min(size, len(s)) >= 24 and linededup.within(lines[j][2], s, t)]
        by[len(s)].append(i)
    gone = {lines[i][:2] for i, r in enumerate(union(len(lines), pairs)) if r != i}
    for d, r in after.items():
        assert r["text"] == "\n".join(x for n, x in enumerate(before[d]["text"].split("\n")) if (d, n) not in gone)
        assert r["n_chars"] == len(r["text"]) or r["text"] == before[d]["text"]
    assert gone and not seen


def test_near_stage(stages):
    before, after = rows(stages[2]), rows(stages[3])
    ids = sorted(before)
    fps = [brute_fingerprint(before[d]["text"]) for d in ids]
    pairs = [(i, j) for j in range(len(ids)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= simhash.MAX_BITS]
    assert after == {d: before[d] for d, r in zip(ids, union(len(ids), pairs), strict=True) if d == ids[r]}


def test_secret_stage(stages):
    before, after = rows(stages[3]), rows(stages[4])
    assert before.keys() == after.keys()
    assert all(r["text"] == secretscan.masked(before[d]["text"]) and r["n_chars"] == len(r["text"]) for d, r in after.items())
    assert not any(re.search("[0-9a-f]{24}", r["text"]) for r in after.values())


def test_packing_stage(stages, spark, sf_small):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in stages[5].collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    texts = rows(stages[4])
    assert pieces.keys() == texts.keys()
    for d, ps in pieces.items():
        ids = np.array([*tok.encode(texts[d]["text"], add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert [(a, n, zlib.crc32(ids[a:a + n].tobytes())) for a, n, _ in sorted(ps)] == sorted(ps) and sum(n for _, n, _ in ps) == len(ids)
    whole = corpus_pipeline.run(spark, sf_small)
    assert whole.count() == stages[5].count() and whole.columns == stages[5].columns


def test_odd_rows_pass_every_stage(spark, docs, odd, sf_small):
    repeated = docs([(10 + i % 2, " ".join(f"w{j}" for j in range(40))) for i in range(6)])
    for frame in (odd, repeated, docs([])):
        for _, f in corpus_pipeline.STAGES[:-1]:
            frame = corpus_pipeline.written(f(spark, frame, sf_small), "odd")
            assert frame.columns == odd.columns
        got = corpus_pipeline.pack(spark, frame, sf_small)
        assert Counter(r["doc_id"] for r in got.where("start = 0").collect()) == Counter(r["doc_id"] for r in frame.collect())
    near = corpus_pipeline.near_dedup(spark, repeated, sf_small).collect()
    assert [r["doc_id"] for r in near] == [10]
