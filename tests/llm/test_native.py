"""Rules, line deduplication, licenses, personal data and mixing against the contracts in plain Python."""

import brute
import duckdb
import pyarrow.parquet as pq
import pytest
from fixtures import frame, odd_documents
from pyspark.sql import functions as F

from scoutline.llm import licenses, linededup, mixing, pii, queries, rules

SF = "/root/testdata/sf0.001"


def texts(sf=SF):
    t = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text", "source"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"])), dict(zip(t["doc_id"], t["source"]))


def by_id(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def pick(row, *names):
    return tuple(row[n] for n in names)


BASE_RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rules_query(spark):
    got, (want, _) = by_id(queries.Q["op10_quality_rules"](spark, SF)), texts()
    assert got.keys() == want.keys()
    for i, text in want.items():
        assert pick(got[i], *BASE_RULES) == brute.quality(text)
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_rules_on_odd_documents(spark):
    book = rules.ledger(frame(spark)).withColumn("base_failed", ~rules.passes(F.col("failed"), "base"))
    got, rows = sorted(book.collect(), key=lambda r: (r.doc_id is None, r.doc_id)), sorted(odd_documents(), key=lambda r: (r[0] is None, r[0]))
    assert [pick(g, *BASE_RULES) for g in got] == [brute.quality(r[1]) for r in rows]


def test_ablation_is_recomputed_from_the_ledger(spark):
    book = rules.ledger(frame(spark)).cache()
    names = rules.POLICIES["v2"]
    rejected = book.filter(~rules.passes(F.col("failed"), "v2")).count()
    for r in rules.ablation(book, "v2").collect():
        without = tuple(n for n in names if n != r.rule)
        assert r.rejected_by_policy == rejected
        assert r.freed_without == rejected - book.filter(~rules.passes(F.col("failed"), without)).count()
        assert r.rejected_alone == book.filter(~rules.passes(F.col("failed"), (r.rule,))).count()


def test_rules_keep_whole_rows(spark):
    docs = frame(spark)
    kept = rules.keep_documents(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rules.apply_policy(rules.ledger(docs), "v2").filter("kept").collect()}


def test_line_dedup_query(spark):
    got, (docs, _) = by_id(queries.Q["op9_line_dedup"](spark, SF)), texts()
    want = brute.line_dedup(list(docs.items()))
    assert {i: pick(r, "n_lines", "n_dropped", "kept_sha256") for i, r in got.items()} == want


def test_line_dedup_on_odd_documents(spark):
    rows = [r for r in odd_documents() if r[0] is not None]
    out = linededup.dedup_lines(frame(spark, rows)).withColumn("sha", F.sha2("text", 256))
    want = brute.line_dedup([(r[0], r[1]) for r in rows])
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.sha) for r in out.collect()} == want
    assert sum(w[1] for w in want.values()) > 0


def test_line_dedup_with_null_and_repeated_ids(spark):
    line = "a line that is long enough to be counted, surely"
    rows = [(None, line)] * 2 + [(1, line)] * 3 + [(2, line), (3, line), (4, f"{line}\nrest\n{line}"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs).collect())
    assert got == [(0, 1, 1), (0, 1, 1), (1, 1, 1), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 3, 0), (9, 1, 0)]


def test_license_query(spark):
    got, (docs, _) = by_id(queries.Q["op5_license_scan"](spark, SF)), texts()
    for i, text in docs.items():
        assert pick(got[i], "n_words", "n_base", "first_word", "last_word", "base_labels") == brute.license_base(text)
        assert set(got[i]["base_labels"].split(",")) - {""} <= set(got[i]["labels"].split(",")) and 0 <= got[i]["score"] <= 1


def test_licenses_on_odd_documents(spark):
    got = sorted(licenses.report(licenses.scan(frame(spark))).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    rows = sorted(odd_documents(), key=lambda r: (r[0] is None, r[0]))
    assert [pick(g, "n_words", "n_base", "first_word", "last_word", "base_labels") for g in got] == [brute.license_base(r[1]) for r in rows]


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0 (the License)", {"apache", "apache-2.0"}),
    ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0"}),
    ("You should have received a copy of the GNU General Public License, version 2", {"gpl", "gpl-2.0"}),
    ("released under CC BY-SA 4.0 International", {"cc-by", "cc-by-sa-4.0"}),
    ("a license to write, all of it by hand", set()),
])
def test_license_labels(spark, text, labels):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert set(licenses.report(licenses.scan(docs)).first().labels.split(",")) - {""} == labels


def test_license_rules_are_many_and_prefiltered():
    table = licenses.rules()
    assert len(table) > 200 and len({r["id"] for r in table}) == len(table)


def test_license_suppression(spark):
    found = [(0, 9, "a", 20, 1), (2, 4, "b", 10, 2), (2, 4, "c", 30, 3), (0, 9, "d", 20, 4), (8, 11, "e", 5, 5)]
    df = spark.createDataFrame([(found,)], f"d {licenses.FOUND}")
    kept = {r["label"] for r in df.select(licenses.unsuppressed(F.col("d")).alias("d")).first().d}
    assert kept == {"a", "c", "e"}


PII = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def test_personal_data_query(spark):
    got, (docs, _) = by_id(queries.Q["op7_personal_data"](spark, SF)), texts()
    for i, text in docs.items():
        assert pick(got[i], *PII) == brute.pii_base(text)
        assert brute.sha(",".join(s for s in got[i]["spans"].split(",") if s.split(":")[0] in pii.KINDS)) == got[i]["base_sha256"]


def test_personal_data_on_odd_documents(spark):
    got = sorted(pii.report(pii.detect(frame(spark))).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    rows = sorted(odd_documents(), key=lambda r: (r[0] is None, r[0]))
    assert [pick(g, *PII) for g in got] == [brute.pii_base(r[1]) for r in rows]
    assert "secret:9:49" in {g.spans for g in got}


@pytest.mark.parametrize("text", [
    "a@b.c_d@e.f", "@x.y a.@b-.c.d.. e@@f.g", "1.2.3.4.5.6.7.8.9 255.255.255.0255 1.2.3", "+1+2 (3) 4-5.6 789 012345", "4111-1111 1111 1111 4111111111111112",
    "12 34", "0" * 17, "+49 (0) 30.123-456-7 ", "9" * 30000, "a" * 30000 + "@b.c", "%@a.b-@c.d", "漢字 a@b.co 字", "1.1.1.1@2.2.2.2",
])
def test_base_spans_match_the_plain_expressions(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert pick(pii.report(pii.detect(docs)).first(), *PII) == brute.pii_base(text)


def test_labelers_that_agree_are_believed():
    post, rates = pii.fit_labelers([("222", 500), ("000", 400), ("221", 50), ("022", 5)])
    assert post["222"] > 0.95 and post["000"] < 0.05 and post["221"] > 0.9
    assert all(rates[k][1][2] > 0.7 for k in range(3))


def test_no_documents(spark):
    none = frame(spark, [])
    assert rules.ledger(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert licenses.report(licenses.scan(none)).count() == 0
    assert pii.report(pii.detect(none)).count() == 0
    assert mixing.mix(none).count() == 0


def _check_mix(rows, size_of):
    sizes = {}
    for r in rows:
        assert r.size == size_of[r.doc_id] and r.taken == r.size * r.passes and r.passes in (0, 1, 2)
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = brute.targets(sizes)
    total = sum(sizes.values())
    assert sum(r.taken for r in rows) <= 1.5 * total
    for s, size in sizes.items():
        own = [r for r in rows if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 2 * max(r.size for r in rows)


def test_mix_query_and_rerun(spark):
    docs, _ = texts()
    once, again = (mixing.mix(spark.read.parquet(f"{SF}/documents.parquet")).collect() for _ in range(2))
    assert sorted(once) == sorted(again)
    _check_mix(once, {i: len(brute.WORD.findall(t or "")) for i, t in docs.items()})


def test_mix_on_odd_documents(spark):
    rows = [r for r in odd_documents() if r[0] is not None]
    _check_mix(mixing.mix(frame(spark, rows)).collect(), {r[0]: len(brute.WORD.findall(r[1] or "")) for r in rows})


def test_mix_is_the_whole_order_cut_once(spark):
    """The same finish times in one DuckDB sort."""
    got = mixing.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.SQL["op8_weighted_mix"]).fetchall()
    assert sorted(tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken").collect()) == sorted(want)
