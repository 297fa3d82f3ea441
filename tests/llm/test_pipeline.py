"""The pipeline, stage by stage, against plain Python (and one SQL statement for the mix)."""

import re
from collections import Counter

import brute
import corpus_pipeline
import duckdb
import pandas as pd
import pytest
from fixtures import frame, odd_documents
from test_free import brute_link, check_packing

from scoutline.llm import packing, sql

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def passes_rules(text):
    n, chars, symbols, dup, _, base = brute.quality(text)
    lines = sum(bool(brute.WORD.search(x)) for x in (text or "").split("\n"))
    upper, bangs, digits = (len(re.findall(p, text or "")) for p in ("[A-Z]", "!", "[0-9]"))
    return not (base or 10 * symbols > n or 100 * dup > 50 * lines or chars < 2 * n or chars > 15 * n or 2 * upper > chars or 10 * bangs > n or 2 * digits > chars)


def keep_lines(docs):
    """(doc_id, text) with shared lines left out."""
    key = lambda line: line.strip(brute.SPACES).translate(brute.LOWER)
    holders = {}
    for i, text in docs:
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    lost = lambda i, k: len(k) >= 40 and len(holders[k]) >= 5 and max(holders[k]) != i
    return [(i, "\n".join(x for x in text.split("\n") if not lost(i, key(x)))) for i, text in docs]


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    source = dict(zip(docs.doc_id, docs.source))
    kept = [(i, t) for i, t in zip(docs.doc_id, docs.text) if passes_rules(t)]
    kept = keep_lines(kept)
    linked = brute_link(kept)
    kept = [(i, t) for i, t in kept if linked[i][2]]
    pd.DataFrame({"doc_id": [i for i, _ in kept], "text": [t for _, t in kept], "source": [source[i] for i, _ in kept]}).to_parquet(tmp_path / "d.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d.parquet')")
    times = {i: taken // size for i, size, _, _, taken in con.execute(sql.MIX).fetchall() if size}
    mixed = [(i, t) for i, t in kept for _ in range(times.get(i, 0))]

    stage = spark.read.parquet(f"{SF}/documents.parquet")
    want = [None, [(i, t) for i, t in kept], mixed]
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage = fn(spark, stage, SF)
        assert stage.columns == COLUMNS
        stage.write.parquet(f"{tmp_path}/{name}")
        stage = spark.read.parquet(f"{tmp_path}/{name}")
        if k >= 2:
            assert Counter((r.doc_id, r.text) for r in stage.collect()) == Counter(want[k - 1])
    rows = packing.pack(stage, with_ids=True).collect()
    check_packing(rows, mixed)
    out = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in out.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


@pytest.mark.parametrize("rows", [odd_documents(), []])
def test_stages_take_odd_tables(spark, tmp_path, rows):
    docs = frame(spark, rows)
    for name, fn in corpus_pipeline.STAGES:
        out = fn(spark, docs, SF)
        if name != "pack_sequences":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
