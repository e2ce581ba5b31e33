"""Token counts of a SentencePiece BPE vocabulary by byte-pair merging with a heap and a linked list.

Every symbol starts as one character; the pair whose joined piece has the best rank is popped from a heap again and again
and joined in a linked list. Only counts are kept: symbols at the start, less the merges done; no identifiers are made.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

SPACE = "▁"


class Vocabulary:
    """Pieces that merges may form, by rank, and the way texts are cut into parts across which no piece reaches."""

    def __init__(self, model_path: str, cache_entries: int = 1_000_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        # A larger score is merged first; equal scores go from left to right.
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        probe = "  a  b \n c "
        if "".join(sp.encode(probe, out_type=str)).replace("<0x0A>", "\n") != SPACE + probe.replace(" ", SPACE):
            raise ValueError("only models with the identity normaliser, a dummy prefix and kept white space are supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("a piece holds a space behind other characters")
        if any(c not in self.rank for p in self.rank for c in p):
            raise ValueError("a piece holds a character that is no piece")
        alone = "\n" if not any("\n" in p for p in self.rank) else ""
        self.parts = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|{alone}" if alone else "")).findall
        self.cache: dict[str, int] = {}
        self.cache_entries = cache_entries

    def part(self, word: str) -> int:
        """Tokens of a part: initial symbols minus merges; characters that no piece holds count one for each byte."""
        get, n = self.rank.get, len(word)
        count = n
        for c in word:
            if c not in self.rank:
                count += len(c.encode()) - 1
        # A symbol is known by where it starts: end[i] is its end and so the next symbol's start; cur[i] is the rank of
        # the pair that starts at i, which tells live heap entries from stale ones.
        heap, cur = [], [-1] * n
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r is not None:
                cur[i] = r
                heap.append((r, i))
        if not heap:
            return count
        heapify(heap)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heappop(heap)
            if cur[i] != r:
                continue
            j = end[i]
            k = end[i] = end[j]
            cur[j] = cur[i] = -1
            count -= 1
            if k < n:
                prev[k] = i
                r = get(word[i : end[k]])
                if r is not None:
                    cur[i] = r
                    heappush(heap, (r, i))
            h = prev[i]
            if h >= 0:
                r = get(word[h:k])
                if r is None:
                    cur[h] = -1
                else:
                    cur[h] = r
                    heappush(heap, (r, h))
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        cache, total = self.cache, 0
        for w in self.parts(SPACE + text.replace(" ", SPACE)):
            n = cache.get(w)
            if n is None:
                n = self.part(w)
                if len(w) <= 64:
                    if len(cache) >= self.cache_entries:
                        cache.clear()
                    cache[w] = n
            total += n
        return total


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process: its cache of parts outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_bytes, n_tokens, over_limit for every whole text, one row per input row.

    Map-only. Null or empty text: 0 bytes, 0 tokens. Null ids and repeated rows are kept row by row. The worker's cache of
    counted parts is bounded and only saves time.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        v = vocabulary(model_path)
        for b in batches:
            texts = b.column("text")
            tokens = [v.count(t) for t in texts.to_pylist()]
            size = pa.compute.binary_length(texts.cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id"), size, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
