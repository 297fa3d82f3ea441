"""Small tables with everything that can go wrong in a document table."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, kept string, t int, n bigint, bucket string, key string, rank int, id int"
LINE = "A line that is shared by many documents, long enough."


def odd_documents():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    texts = [None, "", " \n\t ", "one", "one two", "Two  words", "x" * 5000, "1 " * 3000, "\n" * 50, "é ü ß 漢字", "a\x00b"]
    base = [word() for _ in range(300)]
    for k in range(30):
        copy = list(base)
        for _ in range(k // 2):
            copy[rng.randrange(300)] = word()
        texts.append(" ".join(copy))
    texts += [f"{word()} {word()}\n{LINE if k % 2 else '  ' + LINE.upper()}\n{word()}\n{LINE}" for k in range(8)]
    texts += ["token = \"9abc9ff9ca9fb9e9c999a9eb99999999a999bdde\" From", "mail a.b@mail.example.com, call +1 (555) 123-4567 or 10.0.0.255 and 10.0.0.256; 4111 1111 1111 1111",
              "x@y.z_w@v.u 1.2.3.4.5.6.7.8 0001.2.3.4", "Licensed under the GNU General Public License, version 2. MIT License mit license", "CC BY-NC 4.0 Apache License, Version 2.0",
              " ".join(word() for _ in range(20000))]
    texts += [texts[5]] * 4 + ["same text again and again and again " * 20] * 3
    return [(i if i != 4 else None, text, "en", None if i % 11 == 0 else f"src{i % 4}", None, 1, "x", 2, 3, "b", "k", 4, 5) for i, text in enumerate(texts)]


CLASHING = ("_id", "_text", "_hash", "_keep", "_gone", "_words", "_source", "_size", "_passes", "_lines", "_left", "row", "gone", "words", "text_hash", "passes")


def frame(spark, rows=None):
    docs = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
    return docs.selectExpr("*", *[f"1 AS {name}" for name in CLASHING])
