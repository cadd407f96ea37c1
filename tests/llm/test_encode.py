import random

from samewise.llm.encode import TOKENIZERS, chunks, encode, encoding, join_ids

PARTS = ["a", "b", "'", "l", "s", " ", "  ", "\n", "é", "1", "!", "漢", "'re", " '", "🚲", "e", " "]


def test_chunks_join_to_the_text_and_depend_on_content():
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefg  .,") for _ in range(4000))
    for text in (shared, "", " ", "x" * 10_000, "\n" * 500):
        assert "".join(chunks(text, 80, 400)) == text and all(0 < len(c) <= 400 for c in chunks(text, 80, 400))
    a, b = set(chunks("first post " + shared, 80, 400)), set(chunks("another, longer beginning " + shared, 80, 400))
    assert len(a & b) > 0.8 * len(a)


def test_joins_against_whole_encoding():
    enc, rng = encoding(TOKENIZERS, "byte_bpe_50k"), random.Random(7)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50)))
        at = sorted(rng.sample(range(len(text) + 1), min(len(text), rng.randint(0, 8))))
        parts = [text[i:j] for i, j in zip([0, *at], [*at, len(text)]) if text[i:j]]
        assert join_ids([(p, enc.encode_ordinary(p)) for p in parts], enc) == enc.encode_ordinary(text)


def test_rows(spark):
    long = "Wörter und mehr, don't ask. " * 20_000
    texts = ["", None, "  \n ", "a<|endoftext|>b", long, "reposted text " * 40, "reposted text " * 40, "y" * 9000]
    data = [(i if i != 3 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(0, "again", "clash", "clash")]
    enc = encoding(TOKENIZERS, "byte_bpe_50k")
    got = encode(spark.createDataFrame(data, "doc_id long, text string, ids string, row string"), "doc_id", "text").collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=key) == sorted(((i, enc.encode_ordinary(t or "")) for i, t, *_ in data), key=key)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []
