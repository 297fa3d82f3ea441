"""Tokenizer alignment, piece encoding and conversation repair against brute force."""

import functools
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from fixtures import frame, odd_documents
from tokenizers import Tokenizer

from scoutline.llm import alignment, packing, piecemodel, queries, turnrepair

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "  a  b ", "a\n\nb\t", "\x00", "▁x ▁", "é漢字🙂 x", "<s>hi</s><unk><0x0A> <|endoftext|> x", "�", "​\xa0　x", "x" * 3000,
         "\r\n", " " * 700, " " * 33 + "word", "漢" * 200, "́" * 40, "word" * 800, "one two  three\n\nfour five"]


@functools.cache
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piecemodel.default_model())


@functools.cache
def model():
    return piecemodel.PieceModel(piecemodel.default_model())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- piece encoding -------------------------------------------------------------------------------------

def round_trip(text):
    ids = np.frombuffer(model().encode(text), "<i4").tolist()
    assert ids == library().encode(text or "")
    assert model().decode(ids) == library().decode(ids)


def test_encoding_equals_the_library():
    rng = random.Random(1)
    for text in TEXTS:
        round_trip(text)
    for alphabet in ("ab ", "aeinrst ", "x▁ ", "0123456789 ", "the▁ \n", "éèçà uol", "=-*# \n", "漢字かな。a"):
        for _ in range(400):
            round_trip("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))))
    pieces = list(model().id_of)
    for _ in range(3000):
        round_trip("".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))).replace("▁", " "))


def test_decoding_of_any_ids_equals_the_library():
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.randrange(32000) if rng.random() < .6 else rng.randrange(262) for _ in range(rng.randint(0, 8))]
        assert model().decode(ids) == library().decode(ids)


def test_memory_bounds_change_no_ids(monkeypatch):
    monkeypatch.setattr(piecemodel, "KNOWN_CHUNKS", 3)
    monkeypatch.setattr(piecemodel, "KNOWN_PARTS", 2)
    monkeypatch.setattr(piecemodel, "KNOWN_PAIRS", 2)
    monkeypatch.setattr(piecemodel, "TOGETHER", 4)
    small = piecemodel.PieceModel(piecemodel.default_model())
    text = " ".join(f"word{k % 7} other, thing{k}" for k in range(60))
    for _ in range(3):
        assert np.frombuffer(small.encode(text), "<i4").tolist() == library().encode(text)
        assert np.frombuffer(b"".join(small.encode_all([text, None, "漢 x", text])), "<i4").tolist() == library().encode(text) + library().encode("漢 x") + library().encode(text)
    assert len(small.known) <= 3


def test_side_by_side_equals_the_library():
    rng, texts = random.Random(3), list(TEXTS)
    pieces = list(model().id_of)
    for alphabet in ("ab ", "aeinrst ", "0123456789 a", "the▁ \n", "éèçà uol", "=-*# \n", "漢字かな。a\0"):
        texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))).replace("▁", " ") for _ in range(2000)]
    fresh = piecemodel.PieceModel(piecemodel.default_model())
    for text, ids in zip(texts, fresh.encode_all(texts)):
        assert np.frombuffer(ids, "<i4").tolist() == library().encode(text or ""), text


def test_piece_query(spark):
    got = {r.doc_id: r for r in queries.Q["op12_piece_round_trip"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library().encode(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == (
            len(ids), sha(",".join(map(str, ids))), sha(library().decode(ids)))


def test_piece_odd_rows(spark):
    rows = odd_documents()
    docs = frame(spark, rows + rows[:4])
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in piecemodel.report(piecemodel.decode(piecemodel.encode(docs))).collect())
    ids = [(r[0], library().encode(r[1] or "")) for r in rows + rows[:4]]
    assert got == Counter((d, len(i), sha(",".join(map(str, i)))) for d, i in ids)
    assert piecemodel.report(piecemodel.decode(piecemodel.encode(docs.limit(0)))).count() == 0


# --- alignment ------------------------------------------------------------------------------------------

@functools.cache
def byte_tokens():
    t = Tokenizer.from_file(packing.default_tokenizer())
    t.encode_special_tokens = True
    raw = alignment.ByteTokens(packing.default_tokenizer()).raw
    return t, raw


def brute_groups(text):
    """Groups of (a ids, b ids) by common ends, or None without tokens."""
    if not text:
        return None
    t, raw = byte_tokens()
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = library().encode(text)
    piece = lambda i: bytes([int(library().id_to_piece(i)[3:5], 16)]) if library().is_byte(i) else library().id_to_piece(i).replace("▁", " ").encode()
    bytes_a, bytes_b = [raw[i] for i in a], [piece(i) for i in b]
    whole = b" " + text.encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    cuts, groups = sorted(set(ends_a) & set(ends_b)), []
    for lo, hi in zip([0, *cuts], cuts):
        groups.append(([i for i, e in zip(a, ends_a) if lo < e <= hi], [i for i, e in zip(b, ends_b) if lo < e <= hi]))
    return groups


def brute_alignment(texts):
    every = [brute_groups(t) for t in texts]
    held = Counter()
    for groups in every:
        held.update({(x, y) for a, b in groups or () for x in a for y in b})
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for groups in every:
        links = [(x, y) for a, b in groups or () for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups or ())
        out.append((sum(len(a) for a, _ in groups or ()), sum(len(b) for _, b in groups or ()), len(groups or ()), len(links),
                    sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), sha(text) if groups else ""))
    return out


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {d.doc_id: w for d, w in zip(docs, brute_alignment([d.text for d in docs]))}
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in queries.Q["op11_tokenizer_alignment"](spark, SF).collect()}
    assert got == want


def test_alignment_odd_rows(spark):
    rows = odd_documents() + [(None, t, None, None, None, 1, "x", 2, 3, "b", "k", 4, 5) for t in TEXTS]
    rows += rows[5:9]
    rows = [r for r in rows if len(r[1] or "") < 6000]
    want = Counter((r[0], *w) for r, w in zip(rows, brute_alignment([r[1] for r in rows])))
    assert Counter((r.doc_id, *[r[n] for n in NAMES]) for r in alignment.report(frame(spark, rows)).collect()) == want
    assert alignment.report(frame(spark, rows).limit(0)).count() == 0


def test_alignment_joins_by_shuffle_too(spark):
    docs = frame(spark)
    aligned = alignment.cut_lineage(alignment.align(docs))
    counts = alignment.pair_counts(aligned)
    pick = lambda: sorted((r.row, r.n_best, r.count_sum) for r in alignment.with_counts(aligned, counts).collect())
    before, limit = pick(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert pick() == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# --- conversations --------------------------------------------------------------------------------------

def accepts(state):
    return state in ("", "a")


def brute_repair(turns):
    """Cheapest (cost, audit) over all edit sequences, by search in (turn, grammar state); turns are (initial, fault)."""
    @functools.cache
    def best(i, state):  # state: last initial passed on, "" for none
        options = [(0, "")] if i == len(turns) and accepts(state) else []
        if i < len(turns):
            initial, fault = turns[i]
            cost, rest = best(i + 1, state)
            options.append((cost + 3, "D" + rest))
            if fault not in "bd":
                extra = fault == "t"
                wanted = "a" if state == "u" else "u"
                if initial == wanted or (initial == "s" and state == ""):
                    cost, rest = best(i + 1, initial)
                    options.append((cost + extra, "K" + rest))
                cost, rest = best(i + 1, wanted)
                options.append((cost + 2 + extra, "R" + rest))
        if i == len(turns) and not accepts(state):
            cost, rest = best(i, "a" if state == "u" else "u")
            options.append((cost + 2, "I" + rest))
        elif i < len(turns):  # at most two insertions in a row can pay
            for n in (1, 2):
                at = state
                for _ in range(n):
                    at = "a" if at == "u" else "u"
                cost, rest = no_insert(i, at)
                options.append((cost + 2 * n, "I" * n + rest))
        return min(options)

    @functools.cache
    def no_insert(i, state):
        initial, fault = turns[i]
        cost, rest = best(i + 1, state)
        options = [(cost + 3, "D" + rest)]
        if fault not in "bd":
            extra = fault == "t"
            wanted = "a" if state == "u" else "u"
            if initial == wanted:
                cost, rest = best(i + 1, initial)
                options.append((cost + extra, "K" + rest))
            cost, rest = best(i + 1, wanted)
            options.append((cost + 2 + extra, "R" + rest))
        return min(options)

    return best(0, "")


def chained(turns):
    chain, out = turnrepair.Chain(), []
    for k, (initial, fault) in enumerate(turns):
        out += chain.add(initial, fault, initial + "x", str(k))
    cost, rest = chain.finish()
    return cost, out + rest


@pytest.mark.parametrize("block", [2, 3, 16])
def test_cheapest_least_audit(block, monkeypatch):
    monkeypatch.setattr(turnrepair, "BLOCK", block)
    rng = random.Random(block)
    cases = [t for n in range(4) for t in itertools.product([(r, f) for r in "suax" for f in "-dt"], repeat=n)]
    cases += [tuple((rng.choice("uuuaaasx"), rng.choice("-----tdb")) for _ in range(rng.randint(4, 40))) for _ in range(500)]
    cases += [tuple(("ua"[k % 2], "-") for k in range(100)) + tuple((rng.choice("sua"), rng.choice("--b")) for _ in range(100)), (("x", "b"),) * 50, (("s", "-"),) * 40]
    for turns in cases:
        cost, steps = chained(turns)
        assert (cost, "".join(e for e, _, _ in steps)) == brute_repair(turns), turns
        kept = "".join(role[0] for e, role, _ in steps if e != "D")
        assert not kept or kept.lstrip("s") == "ua" * (len(kept.lstrip("s")) // 2) and kept.count("s") <= 1 and "u" in kept


def test_a_long_conversation_is_not_held():
    rng, chain, most = random.Random(4), turnrepair.Chain(), 0
    for k in range(20000):
        role = rng.choice(["user", "assistant"])
        for _ in chain.add(role[0], rng.choice("----td"), role, "x"):
            pass
        most = max(most, len(chain.waiting))
    assert most < 500


def brute_report(rows):
    """rows: (conv_id, turn, role, text)."""
    words = lambda v: " " if v is None else str(v)
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text, kind = words(role), words(text), zlib.crc32(f"{words(conv)}:{words(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns = set(), []
        for _, role, text in kept:
            body = text.strip(" \t\n\x0b\f\r")
            turns.append((role[:1], "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-"))
            seen.add((role, text))
        cost, audit = brute_repair(tuple(turns))
        left, lines, last = iter(kept), [], ""
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e == "D":
                continue
            if e == "K":
                last = role[0]
            else:
                last = "a" if last == "u" else "u"
                role = {"u": "user", "a": "assistant"}[last]
            lines.append(f"{role}:{text}")
        numbers = [t for t, _, _ in kept if t is not None]
        pairs = [x[0] + y[0] for x, y in zip(turns, turns[1:])]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *[sum(f == k for _, f in turns) for k in "bdt"],
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha("\n".join(lines))))
    return Counter(out)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_conversation_query(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r) for r in queries.Q["op13_conversation_repair"](spark, folder).collect()) == brute_report(rows)


CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string, seen int, fault string, _kind int, dropped boolean, audit string"


def odd_conversations():
    rng = random.Random(9)
    text = lambda: rng.choice([None, "", " ", "Yes.", "No", "Why?", "é 漢。", "a.\n", "x" * 50, "Yes."])
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(9)]), rng.choice([None, "", "user", "assistant", "system", "User", "tool"]), text()) for _ in range(600)]
    rows += [(99, k, ("user", "assistant")[k % 2], f"turn {k}." * (1 + k % 3)) for k in range(900)]
    rows += [(100, None, "user", "Same.")] * 30 + [(k, k % 7, None, None) for k in range(200, 240)]
    return rows + rows[:20]


def test_odd_conversations(spark):
    rows = odd_conversations()
    turns = spark.createDataFrame([(*r, 1, "x", 2, True, "y") for r in rows], CONVERSATIONS)
    got = Counter(tuple(r) for r in turnrepair.report(turnrepair.damage(turns)).collect())
    assert got == brute_report(rows)
    assert turnrepair.report(turnrepair.damage(turns.limit(0))).count() == 0


def test_repaired_turns(spark):
    damaged = turnrepair.damage(spark.createDataFrame([(*r, 1, "x", 2, True, "y") for r in odd_conversations()], CONVERSATIONS))
    steps = {}
    for r in turnrepair.repair(damaged).collect():
        steps.setdefault(r.conv_id, []).append(r)
    for r in turnrepair.report(damaged).collect():
        mine = sorted(steps.get(r.conv_id, []), key=lambda s: s.place)
        assert "".join(s.edit for s in mine) == r.audit
        assert sha("\n".join(f"{s.role}:{s.text}" for s in mine if s.edit != "D")) == r.repaired_sha256


@pytest.mark.parametrize("trouble", ["none", "equal hashes", "small memory"])
def test_alignment_does_not_depend_on_hashes_memory_or_slices(monkeypatch, trouble):
    texts = ["the cat sat on the mat", None, "", "the mat, the mat", "naïve 日本 \n\n the cat", "x" * 400 + " the cat", " ", "the cat sat on the mat"] * 3
    whole = alignment.Aligner(packing.default_tokenizer(), piecemodel.default_model()).align(texts)
    if trouble == "equal hashes":
        monkeypatch.setattr(alignment, "_powers", lambda base, n: np.zeros(n, dtype="u8"))
    if trouble == "small memory":
        monkeypatch.setattr(alignment, "KNOWN_WINDOWS", 2)
    aligner, slices = alignment.Aligner(packing.default_tokenizer(), piecemodel.default_model()), 5
    parts = [aligner.align(texts[i:i + slices]) for i in range(0, len(texts), slices)]
    for name, values in whole.items():
        assert list(values) == [v for p in parts for v in p[name]], name
    again = whole["n_pairs"].reshape(3, -1)
    assert (again == again[0]).all() and whole["groups"][:8] == whole["groups"][8:16]


def test_alignment_encodes_a_word_once_and_odd_texts_whole(monkeypatch):
    rng = random.Random(4)
    bits = ["the", "cat,", "it's", "'s", "a\n\nB", "x▁y", "▁", "naïve", "漢字", "", "\t", "\xa0b", "c ", "\x1cd", "<|endoftext|>", "w" * 60, "\0", "12", "\u0085e", "!"]
    texts = [None, "", " ", *bits] + [" ".join(rng.choices(bits[:4] if k % 2 else bits, k=rng.randint(1, 9))) for k in range(400)]
    for bound in (alignment.KNOWN_WINDOWS, 3):
        monkeypatch.setattr(alignment, "KNOWN_WINDOWS", bound)
        aligner, sent = alignment.Aligner(packing.default_tokenizer(), piecemodel.default_model()), []
        for some in (texts, texts[::-1], ["the cat, the cat,"] * 50):
            want = [aligner.tokens(t) for t in some]
            if some[0] == "the cat, the cat,":
                ids = aligner.b.ids
                monkeypatch.setattr(aligner.b, "ids", lambda x, **how: (sent.extend([x] if isinstance(x, str) else x), ids(x, **how))[1])
            out = aligner.align(some)
            assert out["n_a"].tolist() == [len(a) for a, _ in want] and out["n_b"].tolist() == [len(b) for _, b in want]
            flat = aligner.all_tokens(some)
            assert flat[0].tolist() == [i for a, _ in want for i in a] and flat[2].tolist() == [i for _, b in want for i in b]
        assert sum(map(len, sent)) <= 20


def test_parts_from_before_the_memory_was_full_are_not_encoded_anew(monkeypatch):
    monkeypatch.setattr(piecemodel, "KNOWN_PARTS", 8)
    small, sent = piecemodel.PieceModel(piecemodel.default_model()), []
    side_by_side = small._side_by_side
    monkeypatch.setattr(small, "_side_by_side", lambda parts: (sent.extend(parts), side_by_side(parts))[1])
    for text, new in (("one, two, three,", {"▁one", "▁two", "▁three", ","}), ("four five six seven eight", {"▁four", "▁five", "▁six", "▁seven", "▁eight"}), ("one. two. three.", {"."})):
        sent.clear()
        assert np.frombuffer(small.encode(text), "<i4").tolist() == library().encode(text)
        assert set(sent) == new
