"""Token counts against the library on whole texts; quality rules against plain counts."""

import math
import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

from quarrylane.llm import quality, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(4)
    bits = ["word", "Ünï", "  ", "\n", "\t", "it's", " ", " ", " ", "12345", "...", "日本語", "😀", "<|endoftext|>", "a", "\r\n", "\xa0", "\x1c", "\x85", "!?", "the", "#$", "　"]
    out = [None, "", " ", "\n", "the the the the", "a b c a b c", " lead", "trail ", "x" * 900, "word " * 3000, "a\nb\na\n\n \n \nb"]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randrange(200))) for _ in range(120)]


def test_token_counts(spark):
    rows = [(i % 90, t, "mine") for i, t in enumerate(texts())] + [(None, "no id", None)]
    got = token_counts.with_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3), PATH)
    assert got.columns == ["doc_id", "text", "n_bytes", "n_tokens", "over_limit"]
    library = Tokenizer.from_file(PATH)
    want = [(i, t, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 512) for i, t, _ in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert token_counts.with_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_token_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 5)
    own, library = token_counts.Counter(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        for t in texts():
            assert own.counts([t or ""]) == [len(library.encode(t or "", add_special_tokens=False))]


def plain_base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), seen, len(covered)


def test_base_counts():
    for t in texts():
        if len(t or "") < 5000:
            assert quality.base_counts(t or "") == plain_base(t)


def plain_distance(p, q):
    if not sum(p) or not sum(q):
        return 1.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(max(0, sum(a * math.log2(a / c) for a, c in zip(p, m) if a) / 2 + sum(b * math.log2(b / c) for b, c in zip(q, m) if b) / 2))


def plain_classes(text):
    out = [sum(c in chars for c in text) for chars in quality.CLASSES]
    beyond = sum(ord(c) > 127 for c in text)
    return [*out, len(text) - sum(out) - beyond, beyond]


def plain_words(text):
    return re.sub(r"[\x00-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower()).split(" ")


def test_whole_rule(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(300).collect()
    df = spark.createDataFrame(docs + [(None, None, None), (1, "", "en"), (1, "", "en")], "doc_id long, text string, lang string").repartition(3)
    found = quality.references(df)
    by = {}
    for r in docs:
        c, w = by.setdefault(r.lang, ([0] * quality.N_CLASSES, Counter()))
        c[:] = [a + b for a, b in zip(c, plain_classes(r.text))]
        w.update(x for x in plain_words(r.text) if x)
    want = []
    for lang in sorted(by):
        classes, words = by[lang]
        top = sorted(((w, n) for w, n in words.items() if len(w) <= 4), key=lambda x: (-x[1], x[0].encode()))[:40]
        want.append((tuple(classes), tuple(sorted(top)), sum(words.values())))
    assert found == tuple(want)
    got = quality.with_quality(df, found).collect()
    assert len(got) == 303
    for r in got:
        text = r.text or ""
        n, _, _, _, repeated = base = plain_base(text) if len(text) < 9000 else quality.base_counts(text)
        words = Counter(x for x in plain_words(text) if x)
        far = min((plain_distance(plain_classes(text), c) + plain_distance(
            [*(words[w] for w, _ in top), words.total() - sum(words[w] for w, _ in top)], [*(k for _, k in top), total - sum(k for _, k in top)])) / 2 for c, top, total in want)
        failed = n < 50 or 2 * repeated > n
        assert tuple(r)[3:8] == base and r.base_failed == failed and abs(r.divergence - far) < 1e-9
        assert r.kept == (not failed and far <= quality.MAX_DISTANCE + quality.SLACK / math.sqrt(n))


def test_good_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.with_quality(docs, quality.references(docs)).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert len(good) > 100 and all(r.kept for r in good) and sum(not r.kept for r in bad) >= 0.4 * len(bad)


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, kept string")
    assert quality.references(none) == () and quality.with_quality(none, ()).count() == 0
    one = quality.with_quality(spark.createDataFrame([(1, "w " * 60, "x"), (2, " ".join(map(str, range(60))), "x")], "doc_id long, text string, kept string"), ())
    assert one.columns == ["doc_id", "text", *quality.ADDED] and {r.doc_id: r.kept for r in one.collect()} == {1: False, 2: True}
