import public_tokenizers as P

from spindrift.llm.packing_recall import recall

from .helpers import documents


def test_recall_counts_neighbours_in_other_shards(spark):
    topics = [[f"topic{t}word{i}" for i in range(30)] for t in range(6)]
    rows = documents(spark, [(t * 10 + n, " ".join([*topics[t][n:], *topics[t][:n], f"own{t}x{n}"])) for t in range(6) for n in range(4)])
    path = P.path("byte_bpe_50k.json")
    whole = recall(rows, path, nearest=3)
    assert whole["shards"] == 1 and whole["nearest"] == whole["first"] == 1
    alone = recall(rows, path, nearest=3, shard_ids=1)
    assert alone["shards"] == 24 and alone["nearest"] == alone["first"] == 0
    assert recall(rows.limit(0), path)["nearest"] is None
