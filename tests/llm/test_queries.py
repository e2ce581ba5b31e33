"""The registered queries themselves, against libraries, on a whole small table."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from spindrift.llm import bpe, lm_score, media, token_count

from .helpers import SMALL


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def test_op1(spark, docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op1_bpe(spark, SMALL).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {i: (len(ids := library.encode_ordinary(t)), sha(np.array(ids, "<u4").tobytes()), sha(t.encode())) for i, t in docs.items()}


def test_op3(spark, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.op3_token_count(spark, SMALL).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in docs.items()}


def test_op6_counts_and_base_scores(spark, docs):
    from collections import Counter
    from math import log10

    from .helpers import words

    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    known = Counter(w for i, t in docs.items() if not out[i] for w in [*words(t), None])
    total, kinds = sum(known.values()), len(known)
    got = {r.doc_id: r for r in lm_score.op6_lm_score(spark, SMALL).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        own = [*words(t), None]
        base = sum(log10((known[w] + 1) / (total + kinds + 1)) for w in own)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[i], len(own), sum(known[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score <= 0


def test_op10(spark, docs):
    got = {r.doc_id: r for r in media.op10_media(spark, SMALL).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        raw = t.encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
