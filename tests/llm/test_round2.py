"""Findings of the second review."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_free import extracted
from tokenizers import Tokenizer

from scoutline.llm import htmldiff, packing, pii, rules


# --- page differencing ---------------------------------------------------------------------------------------

LONG = "A paragraph of real text, which says something about the matter."


@pytest.mark.parametrize("html, text", [
    ("<div class='container header-fixed'><article><p>Text</p></article></div>", "Text"),
    ("<div class='wrapper sidebar-mini'><main><p>Text</p></main></div>", "Text"),
    (f"<h1>Title</h1><div class='content social-science'><p>{LONG}</p></div>", f"Title\n\n{LONG}"),
    (f"<article><h1>Title</h1><div class='content social-science'><p>{LONG}</p></div></article>", f"Title\n\n{LONG}"),
    ("<form id=f><div><p>all of the page</p></div></form>", "all of the page"),
    ("<article><p>x <math><mi>y</mi></math> <noscript>z</noscript> <object>open</p><p>end</p></article>", "x y z open\n\nend"),
    ("<article><p>Text</p></article><div class='related'><article><p>Teaser</p></article></div>", "Text"),
    ("<article><p>Text</p><div class='ad'>An advert longer than the text</div></article>", "Text"),
    ("<nav><ul><li>Menu</ul></nav>", ""),
])
def test_marked_containers_do_not_take_the_text_with_them(html, text):
    assert htmldiff.main_text(htmldiff.lines_of(html), set()) == text


@pytest.mark.parametrize("html, text", [
    ("<article><p class='advert'>Buy<p>Text<ul><li class='share'>Tweet<li>Point</ul></article>", "Text\n\nPoint"),
    ("<article><table><tr class='ad'><td>Buy</td></tr><tr><td>Cell</td></tr></table></article>", "Cell"),
    ("<article><ul><li class='share'><ul><li>x</li><li>y</li></ul>z</li><li>Point</li></ul></article>", "Point"),
])
def test_every_block_can_be_furniture(html, text):
    assert htmldiff.main_text(htmldiff.lines_of(html), set()) == text


def test_notices_inside_articles_go_and_quotations_stay(spark):
    quoted = lambda k: "<p>a quoted passage</p>" if k in (3, 4, 5) else ""
    article = lambda k: f"<article><p>own text of page {k}, long enough</p>{quoted(k)}<p>Read our newsletter</p></article>"
    want = [(k, f"own text of page {k}, long enough" + ("\n\na quoted passage" if quoted(k) else "")) for k in range(12)]
    assert extracted(spark, [(k, f"http://h/{k:02}", article(k)) for k in range(12)]) == want
    few = extracted(spark, [(k, f"http://h/{k}", article(k)) for k in range(3)])
    assert all(text.endswith("Read our newsletter") for _, text in few)  # too few pages to tell
    same = [(k, f"http://h/{k}", "<article><p>copy of a page</p><p>on a whole host</p></article>") for k in range(8)]
    assert extracted(spark, same) == [(k, "copy of a page\n\non a whole host") for k in range(8)]


def test_a_large_host_is_many_keys(spark, monkeypatch):
    monkeypatch.setattr(htmldiff, "CHUNK", 4)
    rows = [(k, f"http://h/{k:02}", f"<article><p>own text of page {k}</p><p>Notice</p></article>") for k in range(30)]
    assert extracted(spark, rows) == [(k, f"own text of page {k}") for k in range(30)]


# --- packing ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("ranked", [True, False])
@pytest.mark.parametrize("text", ["see <|endoftext|> here", "<|endoftext|>", "a<|endoftext|>b\n <|endoftext|><|endoftext|> ", "<|endoftext", "plain text"])
def test_added_tokens_have_their_ids(text, ranked, monkeypatch):
    path = packing.default_tokenizer()
    if not ranked:
        monkeypatch.setattr(packing, "_ranks", lambda _: None)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.Encoder(path)(text), "<u4").tolist() == want
    assert (50256 in want) == ("<|endoftext|>" in text)


# --- personal data ----------------------------------------------------------------------------------------------

@pytest.mark.parametrize("token", ["sk-" + "aZ9_" * 40, "0123456789abcdef" * 16, "a1" * 64, "f" * 32])
def test_long_secrets_are_proposed(spark, token):
    df = spark.createDataFrame([(f"key {token} end",)], "text string")
    [r] = df.select(pii.matches(F.col("text"), pii.PROPOSALS["secret"]).alias("m")).collect()
    assert [(m.start, m.end, m.hit) for m in r.m] == [(4, 4 + len(token), token)]


# --- quality rules ----------------------------------------------------------------------------------------------

def test_repeated_windows_do_not_depend_on_the_high_bits_of_the_hash(spark, monkeypatch):
    """A hash of 20 bits, in the place where positions would be, with some equal hashes of different windows."""
    hashed = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: hashed(*c).bitwiseAND(F.lit((1 << 20) - 1).cast("bigint")))
    text = " ".join(f"w{k}" for k in range(4000)) + " x y z" * 3
    [r] = rules.measure(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert r.n_repeat_words == brute.quality(text)[4] == 9
