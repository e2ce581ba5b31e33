"""How many of a document's nearest neighbours its index shard holds: python -m spindrift.llm.packing_recall SF_DIR [CPUS]

The best `nearest` neighbours of sampled documents by BM25 over the whole table are brute force; a neighbour counts as
reachable if pack_documents() deals it to the shard of the document. This is a bound from above on what packing finds,
because a reachable neighbour may be used already. All documents are held on the driver, so this is for tables that fit.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, materialize, table
from .packing import Shard, _distinct, _tokenised, tokens


def recall(docs: DataFrame, tokenizer: str, nearest: int = 4, seeds: int = 500, shard_ids: int = 700_000, task_bytes: int = 16 << 20) -> dict:
    """documents, shards, seeds that have neighbours, and the shares of all nearest and of the first that are reachable."""
    rows = materialize(_tokenised(docs, tokenizer, 1, "doc_id", "text").filter("kind = 0"), "tokens", "lz4")
    n_bytes = rows.agg(F.sum(F.octet_length("ids"))).first()[0] or 0

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in by_bytes(b, "ids", 2 * shard_ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, shard)), part.column("ids")], names=["shard", "ids"])
                shard += 1

    n = int(n_bytes / task_bytes) + 1  # dealt as pack_documents() does
    dealt = rows.select("key", "id", "ids").repartitionByRange(n, "key", "id").sortWithinPartitions("key", "id")
    placed = dealt.select("id", "ids").mapInArrow(run, "shard long, ids binary").toArrow()
    if not placed.num_rows:
        return {"documents": 0, "shards": 0, "seeds": 0, "nearest": None, "first": None}
    shard = placed.column("shard").to_numpy()
    words = tokens(tokenizer).terms([np.frombuffer(x, "<u2")[:-1] for x in placed.column("ids").to_pylist()])
    found, df = np.unique(np.concatenate([_distinct(w) for w in words]), return_counts=True)
    n_words = sum(int((w != 0).sum()) for w in words)
    index = Shard(words, lambda w: df[np.searchsorted(found, w)], len(words), n_words / len(words))
    every, first = [], []
    for d in np.random.default_rng(0).permutation(len(words))[:seeds].tolist():
        score = index.scores(d)
        score[d] = 0
        best = np.argsort(-score, kind="stable")[:nearest]
        same = (shard[best] == shard[d])[score[best] > 0]
        if len(same):
            every.append(same)
            first.append(same[0])
    return {"documents": len(words), "shards": len(np.unique(shard)), "seeds": len(every), "nearest": float(np.concatenate(every).mean()) if every else None, "first": float(np.mean(first)) if first else None}


if __name__ == "__main__":
    import public_tokenizers
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{sys.argv[2] if len(sys.argv) > 2 else 4}]").config("spark.driver.memory", "4g").config("spark.driver.maxResultSize", "2g").config("spark.ui.enabled", "false").getOrCreate()
    print(recall(table(spark, sys.argv[1], "documents"), public_tokenizers.path("byte_bpe_50k.json")))
