"""Content-defined chunks and repeated passages against plain walks."""

import random

import numpy as np

from quarrylane.llm import substrings

ROWS = "doc_id long, text string, spans string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(1, 10))) for _ in range(n))


def plain_ends(raw):
    marks = []
    for i in range(substrings.WINDOW - 1, len(raw)):
        h = sum(int(substrings._GEAR[raw[i - j]]) << j for j in range(substrings.WINDOW)) % (1 << 32)
        if h < (1 << 32) // substrings.AVERAGE:
            marks.append(i)
    ends = [i + 1 for k, i in enumerate(marks) if not k or i - marks[k - 1] > substrings.MIN_GAP]
    return ends if ends[-1:] == [len(raw)] else [*ends, len(raw)]


def test_chunks_by_hand():
    rng = random.Random(3)
    for n in (1, 2, 10, 200):
        raw = words(rng, n).encode()
        assert substrings.chunk_ends(np.frombuffer(raw, np.uint8)).tolist() == plain_ends(raw)
        ends, begun, digests = substrings.chunked(raw.decode())
        assert begun.sum() == n and len(set(digests.tolist())) == len(ends)
    assert [len(x) for x in substrings.chunked(None)] == [0, 0, 0]


def test_chunks_resist_shifts():
    rng = random.Random(4)
    passage = words(rng, 300)
    a, b = (set(substrings.chunked(words(rng, k) + " " + passage)[2].tolist()) for k in (20, 21))
    own = set(substrings.chunked(passage)[2].tolist())
    assert len(own & a & b) >= len(own) - 3


def test_repeats(spark):
    rng = random.Random(5)
    passages = [words(rng, n) for n in (55, 60, 80, 120)]
    rows, planted = [], {}
    for i in range(160):
        text = words(rng, rng.randrange(20, 200))
        if i % 3 == 0:
            k = rng.randrange(4)
            planted.setdefault(k, []).append(i)
            text = f"{text} {passages[k]}\n{words(rng, 30)}"
        rows.append((i, text, "mine"))
    rows += [(500, rows[1][1], "mine"), (None, rows[4][1], "mine"), (600, None, None), (601, "", None), (602, "be " * 2000, None), (603, "be " * 2000, None), (7, rows[7][1], "again")]
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    out = substrings.find_repeats(df)
    assert out.columns == ["doc_id", "n_bytes", "repeat_bytes", "spans", "repeat_of"]
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    late = {i: (k, ids[0]) for k, ids in planted.items() for i in ids[1:]}
    caught = 0
    for i, text, _ in rows[:160]:
        r = got[i][0]
        assert r.n_bytes == len(text.encode())
        if i not in late:
            assert r.repeat_bytes == 0 and r.repeat_of == []
        elif r.spans:
            k, first = late[i]
            inside = b"".join(text.encode()[s["start"]:s["end"]] for s in r.spans)
            assert r.repeat_of == [first] and inside in passages[k].encode() + b"\n"
            caught += 1
    assert caught >= 0.97 * len(late)
    assert got[500][0].repeat_of == [1] and got[500][0].repeat_bytes == got[500][0].n_bytes
    assert got[None][0].repeat_of == [4] and got[603][0].repeat_of == [602] and not got[602][0].spans and not got[7][0].spans
    clean = {r.doc_id: r for r in substrings.remove_repeats(df).collect()}
    assert substrings.remove_repeats(df).columns == df.columns and clean[500].text == "" and clean[600].text is None
    for i in (late.keys() - {7}):
        assert (clean[i].text == dict((a, b) for a, b, _ in rows)[i]) == (not got[i][0].spans) and set(clean[i].text.split()) <= set(dict((a, b) for a, b, _ in rows)[i].split())
    none = df.limit(0)
    assert substrings.find_repeats(none).count() == 0 and substrings.remove_repeats(none).count() == 0
