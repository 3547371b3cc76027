import random

import pytest

WORDS = "the of and to in house river green stone walks under morning light with every small window opens slowly toward garden while children".split()


def prose(seed, n, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + (f"{r.randrange(500)}" if r.random() < 0.5 else "") for _ in range(n))


SECRET = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'


@pytest.fixture(scope="session")
def texts():
    """doc_id, text, lang, source: nulls, empty and long texts, copies, near copies, ties, repeated rows."""
    base = prose(1, 400)
    near = base.replace("house", "houze", 1)
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (4, prose(2, 300), "en", "a"), (5, None, "en", "a"), (6, "", None, "a"),
            (7, " \t\n\x0b\f\r ", "en", None), (8, "two words", "de", "b"), (9, prose(3, 200) + " " + SECRET + " " + prose(4, 90), "de", "b"),
            (10, "AAA " * 3000 + prose(5, 30), "en", "a"), (11, prose(6, 30000), "en", "c"), (12, "\n".join([prose(7, 20)] * 30), "en", "a"),
            (13, "Ünïcode ĸ 🎉 ▁x " + prose(8, 100), "fr", "a"), (14, " ".join(w + "%%%" for w in prose(9, 120).split()), "en", "a"),
            (None, prose(10, 60), "en", "a"), (4, prose(2, 300), "en", "a")]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


CLASH = {"kept": "false", "why": "'x'", "base": "1", "secrets": "2", "fingerprint": "3", "row": "4", "at": "5", "first": "6", "_doc": "7", "_words": "8",
         "n_words": "9", "id": "10", "doc": "11", "_clean": "12", "word_chars": "13", "held_out": "14", "tokens": "15", "host": "16", "a.b": "17"}


@pytest.fixture(scope="session")
def docs(spark, texts):
    d = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return d.selectExpr("*", *[f"{v} AS `{k}`" for k, v in CLASH.items()])


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
