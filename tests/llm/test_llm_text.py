import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from trialspark.llm import text as T


def test_words_are_those_of_the_patterns():
    rng = random.Random(2)
    rows = ["".join(rng.choice("aB1 \t\n\x0b\x1c_-é語😀\x00.") for _ in range(rng.randrange(40))) for _ in range(500)] + [None, ""]
    for kind, pattern in ((T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (T.NONSPACE, r"[^\x20\x09-\x0D]+")):
        seen, back = {}, {}
        for a, b, data, offsets in T.texts(pa.array(rows)):
            h, first = T.words(data, offsets, kind)
            for i in range(a, b):
                low = re.sub("[A-Z]", lambda m: m[0].lower(), rows[i] or "")
                found = re.findall(pattern, low)
                own = h[first[i - a]:first[i - a + 1]]
                assert len(found) == len(own)
                for w, x in zip(found, own):
                    assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w


def test_chunks_cover_sliced_columns():
    col = pa.array(["a b", None, "c" * 3_000_000, "", "d e f"]).slice(1, 4)
    got = []
    for a, b, data, offsets in T.texts(col):
        got += np.diff(T.words(data, offsets, T.NONSPACE)[1]).tolist()
    assert got == [0, 1, 0, 3]
    assert list(T.texts(pa.array([], pa.string()))) == []


def test_long_texts_hash_as_short_ones():
    rng = random.Random(3)
    short = ["".join(rng.choice("abC9") for _ in range(rng.randrange(1, 9))) for _ in range(1000)]
    own = [T.hash_of(w) for w in short]
    (_, _, data, offsets), = T.texts(pa.array([" ".join(short * 400)]))
    assert len(data) > 2 * T.CHUNK_BYTES
    assert T.words(data, offsets, T.ALNUM)[0].view(np.int64).tolist() == own * 400
    # one word longer than a chunk is known by all its bytes
    long = "ab" * T.CHUNK_BYTES
    words = [long + "c", "x", long + "d", long + "c"]
    (_, _, data, offsets), = T.texts(pa.array([" ".join(words)]))
    h = T.words(data, offsets, T.ALNUM)[0].tolist()
    assert h[0] == h[3] != h[2] and h[1] == np.int64(T.hash_of("x")).view(np.uint64)


def test_a_chunk_takes_a_few_megabytes():
    """Hashing a chunk took 40 MB in every worker before, next to an executor whose limit counts them."""
    data = pa.array(["word " * 200] * 3000)
    tracemalloc.start()
    for _, _, chunk, offsets in T.texts(data):
        T.words(chunk, offsets, T.ALNUM)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 16 << 20
