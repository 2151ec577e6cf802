import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seamark.llm import token_ids as ti

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["Hello, world. It's fine.", None, "", " \n\t ", "x" * 5000, "a.b, c. " * 400, "École  œuvre, 12 3.", "<|endoftext|> kept", "★ and a★, b", "İstanbul, ſ.", "Hello, world. It's fine."]


@given(st.lists(st.integers(0, 2**32 - 1), max_size=2000))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip_and_random_access(ids):
    ids = np.array(ids, np.uint32)
    chunks, bitmaps, ranks = ti.dac_encode(ids)
    assert ti.dac_decode(chunks, bitmaps).tolist() == ids.tolist()
    for i in random.Random(1).sample(range(len(ids)), min(20, len(ids))):
        assert ti.dac_access(chunks, bitmaps, ranks, i) == ids[i]


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(text):
    cache = ti.piece_cache(PATH)
    whole = cache.tok.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ti.encode_texts([text.encode()], cache, b"")[0], "<u4").tolist() == whole


def test_file_against_the_tokenizer(spark):
    docs = [(i, t, "x") for i, t in enumerate(TEXTS)]
    random.Random(3).shuffle(docs)
    df = spark.createDataFrame([*docs, (4, "again", "y"), (None, "no id", "z")], "doc_id long, text string, start string").repartition(3)
    path = ti.write_token_ids(df, PATH)
    tok = Tokenizer.from_file(PATH)
    start, want = 0, []
    order = sorted([*docs, (4, "again", "y"), (None, "no id", "z")], key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    stream = []
    for i, t, _ in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        stream += ids
    got = sorted((tuple(r) for r in ti.read_digests(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    places = [0, 5, 5, 5, len(stream) - 1]
    at = ti.tokens_at(spark, path, spark.createDataFrame([(p,) for p in [*places, len(stream), -1, None]], "place long"))
    assert sorted(map(tuple, at.collect())) == [(p, stream[p]) for p in places]
    ids = {r["doc_id"]: list(r["ids"]) for r in ti.read_ids(spark, path).where("doc_id = 0").collect()}
    assert ids[0] == [*tok.encode(TEXTS[0], add_special_tokens=False).ids, 2]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ti.read_digests(spark, ti.write_token_ids(df, PATH)).collect() == []


def test_last_level_ends():
    with pytest.raises(IndexError):
        ti.dac_access(*ti.dac_encode(np.array([1, 2], np.uint32)), 5)
