import random
import time

import public_tokenizers as P
import pytest
import tiktoken

from spindrift.llm import bpe, packing
from spindrift.llm.common import clear_scratch, exists, shared_dir, write_file

from .helpers import documents


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def test_long_words_are_merged_like_short_ones(coder, reference):
    rnd = random.Random(3)
    draw = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    some = [draw(draw("abcdefghijklmnopqrstuvwxyz", rnd.randint(1, 6)), rnd.randint(257, 900)) for _ in range(25)]
    periods = [w * (1200 // len(w)) for w in ("q", "aa", "ab", "the", "ing", "abcde", "etaoi", "xyx")]
    texts = [*some, *periods, draw("etaoin", 3000), draw("0123456789", 2000), draw("=-*", 2000), draw("éàüß", 1500), "走" * 400, " " * 3000 + "x"]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(t)


def test_a_megabyte_without_a_space_takes_seconds(coder):
    rnd = random.Random(4)
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 1_000_000), ("a", 1_000_000), ("etaoin", 100_000)):
        text = "".join(rnd.choice(letters) for _ in range(n))
        start = time.time()
        ids = coder.encode([text])
        assert coder.decode(ids) == [text.encode()] and time.time() - start < 60


def test_long_white_space_is_packed(spark):
    path = P.path("byte_bpe_50k.json")
    text = "ab" + " " * 1_200_000 + "x\n\ny"
    coder = packing.Tokens(path)
    expected = coder.tokenizer.encode(text, add_special_tokens=False).ids
    assert coder.encode([text, "", "plain"])[0].tolist() == expected
    got = packing.pack_documents(documents(spark, [(1, text), (2, "two words")]), path).collect()
    pieces = sorted((r.start, r.ids) for r in got if r.doc_id == 1)
    assert [i for _, ids in pieces for i in ids] == [*expected, 1]


def test_words_of_the_index():
    coder = packing.Tokens(P.path("byte_bpe_50k.json"))
    words = lambda t: set(coder.terms(coder.encode([t]))[0].tolist()) - {0}
    assert words("red\ngreen\tblue, red!") <= words("blue green red") | words("red green blue") | words("x red") | words("x green")
    assert words("没有空格的句子很长很长很长") & words("这个没有空格的句子很长很长很长很长")


def test_a_vocabulary_beyond_16_bits_is_an_error(tmp_path):
    from tokenizers import Tokenizer, models

    path = tmp_path / "wide.json"
    Tokenizer(models.WordLevel({str(i): i for i in range(70_000)}, unk_token="0")).save(str(path))
    with pytest.raises(ValueError, match="16 bits"):
        packing.Tokens(str(path))


def test_scratch_goes(spark):
    root = shared_dir(spark)
    write_file(f"{root}/x.bin", b"x")
    assert exists(f"{root}/x.bin")
    clear_scratch()
    assert not exists(root)


def test_a_worker_keeps_no_files_of_the_operator_before(tmp_path):
    from spindrift.llm import common

    common.resident(("first",), list)
    (tmp_path / "x.bin").write_bytes(b"\1" * 100)
    assert common.map_file(str(tmp_path / "x.bin")).sum() == 100 and common._MAPPED
    common.resident(("first",), list)
    assert common._MAPPED  # the same operator goes on with them
    common.resident(("second",), list)
    assert not common._MAPPED
