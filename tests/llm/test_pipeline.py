"""The whole pipeline against plain versions of its stages."""

import hashlib
import re
import tempfile

import numpy as np
import public_tokenizers
from test_language import plain_breaks
from test_ngram_join import plain_components

import corpus_pipeline
from quarrylane.llm import bpe, language, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 2500").limit(70).collect()
    rows = [tuple(r) for r in docs]
    base = max(r[0] for r in rows) + 1
    rows += [(base + i, r[1].replace(" ", "  ", 3), r[2], "copies", r[4]) for i, r in enumerate(rows[:8])]
    rows += [(base + 20 + i, r[1].replace("e", "a", 1), r[2], None, r[4]) for i, r in enumerate(rows[:8]) if len(r[1]) > 1200]
    rows += [(base + 40, None, None, "src0", None), (base + 41, "123 456", "en", "src0", 7), (base + 42, "кот сидел на окне", None, "src1", 17), (base + 43, "", "en", None, 0)]
    return rows


def plain(rows, samples):
    """Rows of the mix (id, text) by the plain versions."""
    width = {lang: np.log2(len(b"\n".join(language.symbols(t) for t in texts))) for lang, texts in samples}
    used = {lang: set(b"".join(language.symbols(t) for t in texts)) for lang, texts in samples}
    kept = []
    for r in rows:
        if not r[1] or not any(map(str.isalpha, r[1])):
            continue
        best = min((plain_breaks(texts, r[1]) * width[lang], lang) for lang, texts in samples)[1]
        inner = [c for c in language.symbols(r[1]) if c != 32]
        if sum(c in used[best] for c in inner) >= 0.5 * len(inner):
            kept.append(r)
    first = {}
    for r in sorted(kept, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    kept = list(first.values())
    # Near copies: five words, similarity 0.8, over all pairs.
    least = {i for i, _, c in plain_components([r[:2] for r in kept], 5, 80) if i == c}
    kept = [r for r in kept if r[0] in least]
    size = {r[3]: 0 for r in kept}
    for r in kept:
        size[r[3]] += len(WORD.findall(r[1]))
    target, out = mixing.source_targets(size), []
    for s in size:
        times, upto, open_ = min(3, int(target[s] // size[s])), 0, True
        rest = target[s] - times * size[s]
        own = sorted((int(hashlib.md5(str(r[0]).encode()).hexdigest()[:15], 16), r) for r in kept if r[3] == s)
        for _, r in own:
            n = len(WORD.findall(r[1]))
            open_ = open_ and (upto + n <= rest or upto + n - rest < rest - upto)
            upto += n
            out += [(r[0], r[1])] * (times + (open_ and times < 3))
    return out


def test_pipeline(spark):
    rows = documents(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for i, text in plain(rows, language.training_sample(df, "doc_id", "text", "lang")):
        ids = enc.encode_ordinary(text)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert len(want) > 40 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "mixing", "encoding"]
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
