import random
import zlib

import numpy as np
import pytest

from simquarry.llm import token_files as tf
from simquarry.llm.common import scratch_path
from simquarry.llm.queries import op6_token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_library(library):
    rng, encode = random.Random(1), tf.Encoder(PATH, "<u2")
    chars = " \t\n\r\x0b\x1c\x85\xa0'''stremvdllABCzé ß²½×÷_-.,!?09"
    for k in range(1500):
        pool = chars if k % 3 else chars + "　٠中ÿĀ\u0250𝒳"
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(15))) for _ in range(rng.randrange(1, 8))] + ["<|endoftext|> x"] * (k % 50 == 0)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        ids, counts = encode(texts)
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_full_table_is_emptied(library, monkeypatch):
    monkeypatch.setattr(tf, "CACHE", 10)
    encode = tf.Encoder(PATH, "<u2")
    for _ in range(3):
        for t in ("one two three four five six seven", "eight nine ten eleven twelve thirteen"):
            assert encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids


def check(got, docs, library):
    start = 0
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        r = next(x for x in got if x.doc_id == doc_id and x.start == start)
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_query_on_the_table(spark, data, library):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    check(op6_token_files(spark, data).collect(), docs, library)


def test_edge_cases(spark, library):
    rows = [(3, None), (1, ""), (2, "long text " * 30_000), (None, "no id"), (2, "again"), (5, "tail")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    check(tf.token_digest(df, PATH).collect(), [(None, "no id"), (1, ""), (2, "again"), (2, "long text " * 30_000), (3, None), (5, "tail")], library)
    assert tf.token_digest(df.limit(0), PATH).count() == 0


def test_wide_ids_and_damage(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string")
    folder = scratch_path(spark, "wide")
    parts = tf.write_token_files(df, folder, PATH, end_id=70_000)
    ids, offsets, tokens = tf.open_part(folder, parts[0]["part"])
    assert tokens.dtype == np.dtype("<u4") and tokens[offsets[1] - 1] == 70_000 and len(ids) == parts[0]["n_docs"]
    with open(f"{folder.removeprefix('file://')}/{parts[0]['part']}.idx", "r+b") as f:
        f.write(b"broken!!")
    with pytest.raises(ValueError):
        tf.open_part(folder, parts[0]["part"])


def test_words_that_a_linear_hash_confuses(library):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    ids, counts = tf.Encoder(PATH, "<u2")([a, b, f"{a} {b}"])
    want = [library.encode(t, add_special_tokens=False).ids for t in (a, b, f"{a} {b}")]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_colliding_pieces_get_their_own_ids(library, monkeypatch):
    monkeypatch.setattr(tf, "hash_spans", lambda raw, start, end: np.full(len(start), 7, np.uint64))
    encode = tf.Encoder(PATH, "<u2")
    texts = ["one two", "three", "", "two one"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        ids, counts = encode(texts)
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_id_width_follows_the_tokenizer(library):
    assert tf.largest_id(PATH) == max(library.get_vocab().values())
