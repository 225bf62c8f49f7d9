"""Cross-parsing against a plain parse, edge cases and held-out accuracy."""

import math
import random
import zlib

from quarrylane.llm import language

SF = "/root/testdata/sf0.01"


def plain_breaks(train, text):
    """Phrase ends by substring search, block by block."""
    data, known, total = b"\n".join(language.symbols(t) for t in train), set(b"".join(language.symbols(t) for t in train)), 0
    body = language.symbols(text)
    for at in range(0, len(body), language.BLOCK):
        phrase, block = b"", body[at:at + language.BLOCK]
        for c in block:
            grown = phrase + bytes([c])
            if grown in data and c in known:
                phrase = grown
            else:
                total += 1 + (c not in known)
                phrase = bytes([c]) if c in known else b""
        total += 1
    return total


def test_parse_by_hand():
    rng = random.Random(1)
    train = tuple("".join(rng.choice("abcde é") for _ in range(300)) for _ in range(3))
    parser = language.Parser(train)
    for n in (1, 5, 255, 256, 257, 900):
        text = "".join(rng.choice("abcdeé Zß.") for _ in range(n))
        assert language._phrases([language.symbols(text)], (("x", parser),))[0, 0] == plain_breaks(train, text)
    assert parser.bits == math.log2(len(b"\n".join(language.symbols(t) for t in train)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    samples = language.training_sample(docs, "doc_id", "text", "lang")
    got = language.identify(docs, samples).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == docs.count() and len(held) > 150
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    again = {r.doc_id: r.lang_pred for r in language.identify(docs.drop("lang", "source").repartition(5), samples).collect()}
    assert again == {r.doc_id: r.lang_pred for r in got}


def test_training_rows(spark):
    rows = [(i, f"text number {i} of many", "xx" if i % 2 else None) for i in range(80)]
    used = language.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    want = sorted(t for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 != 2)
    assert [lang for lang, _ in used] == ["xx"] and sorted(used[0][1]) == want


def test_edges(spark):
    samples = (("aa", ("the cat sat on the mat",)), ("bb", ("der hund und die katze",)))
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 .. \n", "x"), (4, "the cat", "x"), (4, "der hund", "x"), (None, "the mat " * 9000, "x"), (6, "кот сидел", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.text: r for r in language.identify(df, samples).collect()}
    assert [got[t].lang_pred for t in (None, "", "123 .. \n", "the cat", "der hund", "the mat " * 9000)] == ["und", "und", "und", "aa", "bb", "aa"]
    assert got["кот сидел"].known == 0.0 and df.columns != language.identify(df, samples).columns
    assert language.identify(df.limit(0), samples).count() == 0
    assert {r.lang_pred for r in language.identify(df, ()).collect()} == {"und"}
    train = spark.createDataFrame([(i, t, lang) for i in range(8) for lang, (t,) in samples] + [(90, "кот сидел", None), (91, None, "aa")], "doc_id long, text string, lang string")
    kept = language.known_language(train)
    assert kept.columns == train.columns and kept.count() == 16


def test_known_language_holds_each_text_once(spark):
    """The text travels in its row and to the function, not as a column of its own besides."""
    docs = spark.createDataFrame([(i, f"the cat sat on mat {i}", "en") for i in range(20)], "doc_id long, text string, lang string")
    kept = language.known_language(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20))
    assert "body" not in kept._jdf.queryExecution().optimizedPlan().toString()
