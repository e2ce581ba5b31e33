import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from spindrift.llm import bpe, packing, token_count

from .helpers import ODD, SMALL, documents


@pytest.fixture(scope="module")
def texts():
    random.seed(5)
    alphabet = " a b'sdéß\n\t  12!?.　漢\x1c\x85\0"
    return [t or "" for _, t in ODD] + ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(1500)]


def test_bpe_is_that_of_the_library(texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    coder = bpe.Bpe(path, P.PATTERN, most_words=300, most_pieces=200)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for lo in range(0, len(texts), 300):
        part = texts[lo : lo + 300]
        ids = coder.encode(part)
        assert [x.tolist() for x in ids] == [library.encode_ordinary(t) for t in part]
        assert coder.decode(ids) == [t.encode() for t in part]


def test_round_trip_columns(spark):
    rows = documents(spark, ODD)
    path = P.path("byte_bpe_50k.tiktoken")
    got = bpe.round_trip(rows, path, P.PATTERN).collect()
    assert len(got) == len(ODD) and {(r.doc_id, r.decoded_sha256) for r in got} == {(i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ODD}
    empty = next(r for r in got if r.doc_id == 1)
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest()
    back = bpe.decode_ids(bpe.encode_texts(rows, path, P.PATTERN), path, P.PATTERN)
    assert {(r.doc_id, bytes(r.bytes)) for r in back.collect()} == {(i, (t or "").encode()) for i, t in ODD}
    assert bpe.round_trip(rows.limit(0), path, P.PATTERN).count() == 0


def test_counts_are_those_of_the_library(spark, texts):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own = token_count.Vocabulary(path)
    clean = [t for t in texts if "\0" not in t]
    assert [own.count(t) for t in clean] == [len(library.encode(t)) for t in clean]
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.count_tokens(documents(spark, ODD), path, limit=2000).collect()}
    assert got[1] == (0, 0, False) and got[7][2] is True and got[7][0] == 24000


def check_pieces(rows, expected, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in expected.items():
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert zlib.crc32(np.array(ids[r.start : at], "<u4").tobytes()) == r.ids_crc32
            assert "ids" not in r or r.ids == ids[r.start : at]
        assert at == len(ids)
    assert not by_doc
    short = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size and at & (at - 1) == 0
        short += at < size
    return len(by_sequence), short


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for n, (i, t) in enumerate(ODD) if i is not None and n != 4]
    got = packing.pack_documents(documents(spark, rows), path, size=64, shard_ids=300, task_bytes=4000).collect()
    sequences, short = check_pieces(got, {i: library.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}, 64)
    assert sequences > 100 and short <= 6 * 8
    assert packing.pack_documents(documents(spark, []), path).count() == 0
    assert packing.pack_documents(documents(spark, ODD), path).select("length").groupBy().sum().first()[0] == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ODD)


def test_packing_tokens_are_those_of_the_library(texts):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own, library = packing.Tokens(path), Tokenizer.from_file(path)
    assert own.fast is not None
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in own.encode(texts)] == expected
    own.fast = None
    assert [x.tolist() for x in own.encode(texts)] == expected
    a, none, b = own.terms(own.encode(["x apple pear, fig", "", "y fig!! apple pear"]))
    assert len(none) == 0
    assert len(set(a.tolist()) & set(b.tolist())) == 3


def test_seeds_get_their_nearest_neighbours():
    def near(t):
        return np.array([hash(w) & 0xFFFFFFFF for w in t.split()], np.uint64) + np.uint64(1)

    docs = ["apple pear plum fig", "stone sand clay mud", "apple pear plum nut", "stone sand clay ash"]
    index = packing.Shard([near(d) for d in docs], lambda w: np.full(len(w), 2), 4, 4.0)
    assert set(np.flatnonzero(index.scores(0))) == {0, 2}
    windows = packing.Windows(8, 0)
    rows = list(packing.fill_shard(list("abcd"), [np.arange(4)] * 4, windows, index)) + windows.close()
    assert [(r[0], r[3]) for r in rows] == [("a", 0), ("c", 0), ("b", 1), ("d", 1)]


def test_packing_query_on_a_table(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    _, short = check_pieces(packing.op5_packing(spark, SMALL).collect(), {r.doc_id: library.encode(r.text, add_special_tokens=False).ids + [1] for r in docs}, 2048)
    assert short <= 11
