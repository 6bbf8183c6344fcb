"""Words are told apart whatever their letters: Thue-Morse words have equal polynomial hashes modulo 2**64."""

import random
import zlib

import numpy as np

from homeledger.llm import decontamination, token_output
from homeledger.llm.common import Slices, word_hashes


def clashing(n=10):
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_polynomial_hashes_clash_and_word_hashes_do_not():
    a, b = clashing()
    data = np.frombuffer((a + b).encode(), np.uint8)
    starts, ends = np.array([0, 1024]), np.array([1024, 2048])
    assert len(set(Slices(data).hashes(starts, ends).tolist())) == 1
    assert len(set(word_hashes(data, starts, ends).tolist())) == 2


def test_equal_words_hash_alike_wherever_they_stand():
    rng = random.Random(1)
    words = ["x" * n for n in range(0, 40)] + ["".join(rng.choice("ab") for _ in range(rng.choice((1, 7, 8, 9, 511, 512, 513, 2000)))) for _ in range(300)]
    words += words
    rng.shuffle(words)
    raw = "".join(words).encode()
    ends = np.cumsum([len(w) for w in words])
    h = word_hashes(np.frombuffer(raw, np.uint8), ends - [len(w) for w in words], ends)
    assert len(set(h.tolist())) == len(set(words)) == len(set(zip(h.tolist(), words, strict=True)))


def test_terms_of_clashing_words(spark):
    a, b = clashing()
    docs = spark.createDataFrame([(1, f"one {a} two"), (2, f"one {b} two")], "doc_id long, text string")
    items = spark.createDataFrame([(5, f"{b} two")], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.contamination(docs, items).collect()} == {1: (0, 0), 2: (2, 1)}


def test_tokens_of_clashing_words(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    a, b = clashing()
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    ids = [*Tokenizer.from_file(path).encode(f"{a} {b}", add_special_tokens=False).ids, 2]
    got = token_output.token_output(spark.createDataFrame([(1, f"{a} {b}")], "doc_id long, text string"), path).first()
    assert (got.n_tokens, got.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def near(text, item, slop):
    """Whether each word of the item is within slop words of one occurrence of its rarest word in this text."""
    w, q = text.split(), item.split()
    if not q or any(x not in w for x in q):
        return False
    return any(all(any(w[j] == x for j in range(max(0, i - slop), min(len(w), i + slop + 1))) for x in q) for r in q for i in range(len(w)) if w[i] == r)


def test_proximity_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("pqrstuvwxyz") for _ in range(rng.randrange(0, 14))) for _ in range(60)]
    for slop in (1, 3):
        for item in ("p q", "r s t"):
            docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
            # one text a segment, so that the rarest term is the rarest of the text
            got = {r.doc_id for t in [docs] for r in decontamination.search(decontamination.index(t.repartition(8, "doc_id")), spark.createDataFrame([(1, item)], "item_id long, text string"), slop=slop).where("size(items) > 0").collect()}
            assert got <= {i for i, t in enumerate(texts) if near(t, item, slop)}
            if " " in item and len(item.split()) == 2:  # of two words the rarest one makes no difference
                assert got == {i for i, t in enumerate(texts) if near(t, item, slop)}


def test_long_items_are_cut(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(500)}" for _ in range(900))
    w = long.split()
    docs = spark.createDataFrame([(i, " ".join(w[i * 30 : i * 30 + 40]) + " else") for i in range(25)] + [(99, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(1, long), (2, "w1")], "item_id long, text string")
    cols = ["doc_id", "n_words", "starts", "ends", "items"]
    seen = [sorted(map(tuple, decontamination.search(decontamination.index(docs), items, **k).select(cols).collect())) for k in ({}, {"piece": 7}, {"piece": 7, "chunk_terms": 300})]
    assert seen[0] == seen[1] == seen[2] and seen[0][0][2] == [0] and seen[0][0][3] == [40]
