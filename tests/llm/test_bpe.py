"""BPE by chunks against the library on whole texts, and the exact round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from quarrylane.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ROWS = "doc_id long, text string, token_ids string, row string"


def texts():
    rng = random.Random(11)
    bits = ["word ", "Ünï", "  ", "\n\n", "\t", "it's ", "12345", "...", "日本語", "😀", "<|endoftext|>", "a", " ", "\r\n", "\xa0", "!?", "é"]
    out = [None, "", " ", "\n", "short", "x" * 700, " " * 500, "ab " * 400, "0" * 300 + " tail " * 50]
    out += ["".join(rng.choice(bits) for _ in range(rng.randrange(400))) for _ in range(60)]
    return [(i % 50, t, "old", "mine") for i, t in enumerate(out)] + [(None, "no id", None, None)]


@pytest.mark.parametrize("chunk,overlap", [(40, 30), (64, 24), (200, 60), (65_536, 1_024)])
def test_encode(spark, chunk, overlap):
    rows = texts()
    got = bpe.encode(spark.createDataFrame(rows, ROWS).repartition(3), PATH, PATTERN, chunk=chunk, overlap=overlap)
    assert got.columns == ["doc_id", "text", "row", "token_ids"]
    enc = bpe.encoding(PATH, PATTERN)
    got = bpe.decode(got, PATH).collect()
    assert len(got) == len(rows)
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((a, b)) for a, b, _, _ in rows)
    for r in got:
        assert np.frombuffer(r.token_ids, "<u4").tolist() == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


@pytest.mark.parametrize("chunk,overlap", [(64, 24), (65_536, 1_024)])
def test_digests(spark, chunk, overlap):
    got = bpe.encoded_digests(spark.createDataFrame(texts(), ROWS).drop("token_ids"), PATH, PATTERN, chunk=chunk, overlap=overlap)
    enc, want = bpe.encoding(PATH, PATTERN), []
    for i, t, _, _ in texts():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert bpe.encoded_digests(spark.createDataFrame([], ROWS), PATH, PATTERN).count() == 0


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame(texts(), ROWS), PATH, PATTERN, chunk=10, overlap=10)
