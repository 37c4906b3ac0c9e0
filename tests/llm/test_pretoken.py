import numpy as np
import public_tokenizers
import tiktoken

from factloom.llm import packing, pretoken

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = ["", "\0", "a\0b", "don't it's 'll", "  x  \n y", "é" * 3000, "\U0001f600 ́x", "ab " * 2000 + "x", "é" * 2999 + "è", "", "a a b"]


def test_equal_matches_are_looked_up_once(monkeypatch):
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pretoken.ranks(PATH), special_tokens={})
    want = [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in TEXTS]
    asked = []

    class Known(dict):
        def get(self, key):
            asked.append(key)
            return super().get(key)

    for collide in (False, True):  # where all hashes are equal, matches that differ still get their own ids
        if collide:
            monkeypatch.setattr(pretoken, "_factors", lambda: np.zeros(1024, np.uint64))
        own = pretoken.Pieces(pretoken.rank_pieces(PATH).encode, "tiktoken")
        own.known = Known()
        assert own.ids(TEXTS) == want and own.ids(TEXTS) == want
        assert own.ids([]) == [] and own.ids(["", ""]) == [b"", b""]
        if not collide:
            assert len(asked) == 2 * len(set(asked))


def test_pieces_without_ids(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS[3:], None, "word " * 3000])], "doc_id long, text string")
    with_ids = packing.pieces(docs, PATH)
    bare = packing.pieces(docs, PATH, keep=False)
    assert "ids" not in bare.columns
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, with_ids.drop("ids").collect()))
