"""Packing, top-k, near-duplicates, classifier and page differencing against brute force."""

import functools
import random
import zlib

import brute
import numpy as np
import pandas as pd
import pytest
from fixtures import frame, odd_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scoutline.llm import htmldiff, nbsvm, oddsketch, packing, queries, topk

SF = "/root/testdata/sf0.001"


# --- packing ------------------------------------------------------------------------------------------

@functools.cache
def tokenizer():
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    return t


def plain_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


def check_packing(rows, texts):
    """rows with ids; texts: list of (doc_id, text)."""
    want = sorted(zlib.crc32(np.array(p, "<u4").tobytes()) for _, t in texts for ids in [plain_ids(t)]
                  for p in [ids[s:s + n] for s, n in packing.cut(len(ids), 1024)])
    assert sorted(r.ids_crc32 for r in rows) == want
    sequences = {}
    for r in rows:
        assert len(r.ids) == r.length <= 1024
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences), sum(r.length for r in rows)


def test_packing_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(docs, with_ids=True).collect()
    n, tokens = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= 1.03 * -(-tokens // 1024) + 1
    by_doc = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).extend(r.ids)
        assert r.start == len(by_doc[r.doc_id]) - r.length
    assert all(by_doc[r.doc_id] == plain_ids(r.text) for r in docs.limit(20).collect())


def test_packing_odd_documents(spark):
    check_packing(packing.pack(frame(spark), with_ids=True).collect(), [(r[0], r[1]) for r in odd_documents()])
    assert packing.pack(frame(spark, [])).count() == 0


def test_sequences_hold_their_ids(spark):
    out = packing.sequences(packing.pack(frame(spark), with_ids=True)).collect()
    assert sum(i == 2 for r in out for i in r.ids) >= len(odd_documents()) and all(len(r.ids) <= 1024 for r in out)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab.,'9é  漢s!", max_size=40))
def test_words_encode_alone_as_in_the_text(text):
    want = tokenizer().encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder_of(packing.default_tokenizer())(text), "<u4").tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_plan_uses_every_piece_once(histogram):
    groups = packing.plan(histogram, 64)
    used = {}
    for content, n in groups:
        assert sum(content) <= 64 and n > 0
        for v in content:
            used[v] = used.get(v, 0) + n
    assert used == histogram
    table = packing.slots(groups)
    assert len(table["length"]) == sum(len(c) for c, _ in groups)


def test_fit_reproduces_a_histogram_made_of_patterns():
    histogram = np.zeros(65)
    for content, n in (((40, 24), 50), ((30, 20, 14), 70)):
        for v in content:
            histogram[v] += n
    patterns = packing._patterns(np.nonzero(histogram)[0], 64)
    x = packing.fit_counts(histogram, patterns, 3000)
    made = np.zeros(65)
    for p, n in zip(patterns, x):
        for v in p[p > 0]:
            made[v] += n
    assert np.abs(made - histogram).max() < 0.5


# --- top-k ---------------------------------------------------------------------------------------------

def brute_top(rows, k=20, every=20):
    v = [(i, np.floor(64 * np.asarray(x, dtype=float)).astype(int)) for i, x in rows if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)]
    out = []
    for q, a in v:
        if q % every == 0:
            best = sorted((-int(a @ b), i) for i, b in v if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_query(spark):
    t = pd.read_parquet(f"{SF}/embeddings.parquet")
    assert sorted(tuple(r) for r in queries.Q["op6_exact_top_k"](spark, SF).collect()) == brute_top(list(zip(t.vec_id, t.embedding)))


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_with_ties_and_bad_vectors(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(3)
    rows = [(i, (scale * rng.normal(size=6)).tolist()) for i in range(150)] + [(i, [0.5 * scale] * 6) for i in range(150, 260)]
    rows += [(260, None), (280, [None] * 6), (300, [float("nan")] * 6), (301, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (320, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<double>, id int, rank string")
    assert sorted(tuple(r) for r in topk.top_k(df, "vec_id % 20 = 0").collect()) == brute_top(rows)


def test_top_k_of_few(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert topk.top_k(df([]), "vec_id % 20 = 0").count() == 0
    assert topk.top_k(df([(0, [1.0])]), "vec_id % 20 = 0").count() == 0
    assert [tuple(r) for r in topk.top_k(df([(0, [1.0]), (1, [2.0])]), "vec_id % 20 = 0").collect()] == [(0, 1, 1, 64 * 128)]


# --- near-duplicates --------------------------------------------------------------------------------------

def brute_link(docs):
    sets = {i: oddsketch.shingle_set(t or "") for i, t in docs}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def linked(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_near_duplicates_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    want = brute_link(list(zip(docs.doc_id, docs.text)))
    assert any(i != c for i, (_, c, _) in want.items())
    assert linked(queries.Q["op2_near_duplicates"](spark, SF)) == want


def test_near_duplicates_of_odd_documents(spark):
    rows = [r for r in odd_documents() if r[0] is not None]
    assert linked(oddsketch.link(frame(spark, rows))) == brute_link([(r[0], r[1]) for r in rows])
    assert oddsketch.link(frame(spark, [])).count() == 0
    kept = oddsketch.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns and kept.filter("doc_id IS NULL").count() == 1


@pytest.mark.parametrize("words, copies, edits, seed", [(60, 70, 6, 1), (120, 60, 18, 2), (25, 80, 3, 3)])
def test_links_around_the_threshold(spark, words, copies, edits, seed, monkeypatch):
    """Groups of copies edited so that many pairs are just above and below 80 percent."""
    monkeypatch.setattr(oddsketch, "BLOCK", 16)
    rng = random.Random(seed)
    rows = []
    for g in range(3):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(edits)):
                text[rng.randrange(words)] = f"w{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(text)))
    assert linked(oddsketch.link(spark.createDataFrame(rows, "doc_id bigint, text string"))) == brute_link(rows)


def test_odd_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for similar in (0.7, 0.8, 0.9, 0.95):
        n, errors = 2000, []
        shared = int(2 * n * similar / (1 + similar))
        for _ in range(30):
            h = rng.integers(0, 2**64, 2 * n, dtype=np.uint64)
            a, b = np.concatenate([h[:shared], h[shared:n]]), np.concatenate([h[:shared], h[n:2 * n - shared]])
            z = int(np.bitwise_count(oddsketch.odd_sketch(oddsketch.minhashes(a)).view(np.uint64) ^ oddsketch.odd_sketch(oddsketch.minhashes(b)).view(np.uint64)).sum())
            errors.append(1 + 512 / 800 * np.log(1 - 2 * z / 512) - similar)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 60)]
    got = {r.id: r.label for r in oddsketch.components(spark.createDataFrame(path + star, "id bigint, hub bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 60)}


# --- classifier --------------------------------------------------------------------------------------------

def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.Q["op3_quality_classifier"](spark, sf).collect()}
    labels = pd.read_parquet(f"{sf}/labels.parquet")
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [(rows[i].predicted, q) for i, q in zip(labels.doc_id, labels.quality) if rows[i].held_out]
    assert len(held) > 100 and np.mean([p == q for p, q in held]) > 0.93


def test_classifier_edge_cases(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 1), (7, None, 1)], "doc_id bigint, quality int, toxic int")
    model = nbsvm.train_model(docs, labels)
    assert nbsvm.score(docs, model).count() == docs.count()
    constant = nbsvm.train_model(docs, labels.filter("quality = 1"))
    assert len({round(r.score, 9) for r in nbsvm.score(docs, constant).collect()}) == 1
    assert nbsvm.score(frame(spark, []), nbsvm.train_model(frame(spark, []), labels.limit(0))).count() == 0


def test_ngrams_do_not_depend_on_windows(monkeypatch):
    text = "".join(random.Random(1).choice("abcé ") for _ in range(3000))
    seen = np.zeros(nbsvm.FEATURES, bool)
    whole = nbsvm.ngrams(text, seen)
    monkeypatch.setattr(nbsvm, "WINDOW", 64)
    assert (nbsvm.ngrams(text, seen) == whole).all() and not seen.any() and len(nbsvm.ngrams("a", seen)) == len(nbsvm.ngrams("", seen)) == 0


def test_hinge_fit_separates():
    rng = np.random.default_rng(2)
    rows = [np.array([i % 2, 2 + int(rng.integers(50))], np.int32) for i in range(200)]
    y = np.array([i % 2 for i in range(200)])
    w = nbsvm.fit_hinge(rows, [np.array([0.7, 0.7])] * 200, y)
    assert all((w[r] @ [0.7, 0.7] + w[-1] > 0) == (label == 1) for r, label in zip(rows, y))


# --- page differencing ---------------------------------------------------------------------------------------

def lcs_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    at = htmldiff.common_lines(a, b)
    assert at == sorted(set(at)) and len(at) == lcs_length(a, b)
    rest = iter(b)
    assert all(a[k] in rest for k in at)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p><b>First <i>part</i><br>more<p>Second &nbsp; &lt;tag&gt;</p>
<script>var t="</p>";</script><!-- no --><form>Mail</form><div class="share">Tweet</div></article><section id="comments"><p>Nice!</p></section>
<aside>Side</aside><footer>&copy; me</footer></body></html>"""


def extracted(spark, rows):
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "page_id bigint, url string, html string, text int, key string")
    return sorted(((r.page_id, r.text) for r in htmldiff.extract(df).collect()), key=lambda r: (r[0] is None, r[0]))


def test_article_without_furniture(spark):
    text = "A & B\n\nFirst part more\n\nSecond <tag>"
    assert extracted(spark, [(1, "http://a.b/x", PAGE), (2, None, PAGE), (3, "http://a.b/x", None), (4, "nonsense", "")]) == [(1, text), (2, text), (3, ""), (4, "")]


def test_containers_named_after_what_they_hold_are_kept(spark):
    html = "<div class='page with-sidebar'><article><div class='article-header'><h1>Title</h1></div><p>Text</p><div class='ad-box'>Buy</div></article></div>"
    assert extracted(spark, [(1, "http://h/1", html)]) == [(1, "Title\n\nText")]


def test_differencing_deletes_what_the_site_repeats(spark):
    page = lambda body: f"<body><div>Our site</div><div>{body}</div><p>more of {body}</p><div>All about us</div></body>"
    rows = [(k, f"https://h.example/{k}?q=1", page(f"text number {k}, which is longer than the frame")) for k in range(9)]
    want = [(k, f"text number {k}, which is longer than the frame\n\nmore of text number {k}, which is longer than the frame") for k in range(9)]
    assert extracted(spark, rows) == want
    alone = extracted(spark, rows[:1])
    assert alone[0][1].startswith("Our site")  # nothing to compare with


def test_quoted_prose_and_copies_stay(spark):
    article = lambda k: f"<article><p>quoted passage</p><p>own text of page {k}</p><div>Subscribe</div></article>"
    rows = [(k, f"http://h/{k}", article(k)) for k in range(4)]
    assert extracted(spark, rows) == [(k, f"quoted passage\n\nown text of page {k}") for k in range(4)]
    same = [(k, f"http://h/{k}", "<div>copy</div><div>of a page</div>") for k in range(3)] * 2
    assert extracted(spark, same) == [(k, "copy\n\nof a page") for k in range(3) for _ in range(2)]
    assert extracted(spark, []) == []


def test_pages_query(spark):
    rows = queries.Q["op1_html_extraction"](spark, SF).collect()
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    assert sorted(r.page_id for r in rows) == sorted(pages.page_id)
    for r in rows:
        assert r.n_chars == len(r.text) > 0 and "<" not in r.text.replace("< ", "") and r.text.strip() == r.text


def test_positions_are_consecutive(spark):
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.example/{k}", f"<p>{k}") for k in range(50)], "page_id bigint, url string, html string")
    got = sorted((r.at, r.host, r.path) for r in htmldiff.in_order(htmldiff.page_lines(pages)).collect())
    assert [g[0] for g in got] == list(range(50)) and [g[1:] for g in got] == sorted(g[1:] for g in got)


def test_brute_targets_share_everything():
    assert abs(sum(brute.targets({"a": 100, "b": 5, None: 60}).values()) - 1.5 * 165) < 1e-9
