"""Byte-level BPE by recursive DuckDB queries that run in each Spark partition.

The words of a batch (matches of the split pattern, each taken once) become token-position rows, one per byte. A
recursive query joins neighbouring rows with the merge table and contracts each word's leftmost pair of minimum rank,
until no word has a pair left. Decoding joins ids with the vocabulary and aggregates the bytes in position order.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import local_dir, table, text_of

#: From start(g, t), a row for each byte of each word, to the rows of its tokens; g is the word's number << 8 and the byte's
#: place, so it orders all rows. A step joins each row and its right neighbour u with merges, finds each word's pair of
#: least rank (its id, then its place) and contracts it.
ENCODE_SQL = """
with recursive s(g, t, u, done) as (
  select g, t, case when lead(g) over (order by g) >> 8 = g >> 8 then lead(t) over (order by g) end, false from start
  union all
  (with c as (select s.g, s.t, m.id as m from s left join merges m on s.t = m.l and s.u = m.r where not done),
        b as (select g >> 8 as w, min(m::bigint << 8 | (g & 255)) as k from c where m is not null group by g >> 8),
        e as (select c.g, c.t, b.k >> 8 as m, (c.g >> 8 << 8) | (b.k & 255) as spot from c left join b on c.g >> 8 = b.w),
        f as (select g, case when g = spot then m else t end as t, spot, lag(g) over (order by g) as before from e)
   select g, t, case when lead(g) over (order by g) >> 8 = g >> 8 then lead(t) over (order by g) end, spot is null
   from f where spot is null or before is null or before <> spot)
)
select g >> 8 as w, t from s where done order by g
"""

#: The same from start(w, p, t) for long words: a step contracts every pair that nothing can forestall. A pair of rank m is
#: forestalled if its left or right token may get into another merge before: with its present neighbour (the pairs before
#: and after, whose ranks are `m0` and `m1`), or with a longer token that the neighbour may grow into (`grown0`, `grown1`: the
#: least rank of such a merge, by the neighbour and the byte beyond it). Of a run of equal pairs every other one is taken, from
#: the left, or the first alone if merges with the new token may have a lower rank (table solo). The word's leftmost pair of
#: minimum rank is taken in any case.
ENCODE_LONG_SQL = """
with recursive s(w, p, t, done) as (
  select w, p, t, false from start
  union all
  (with n as (select w, p, t, lag(t) over o as t0, lead(t) over o as t1, lag(tail) over o as tail0, lag(tail, 2) over o as tail00, lead(head, 3) over o as head3,
                     lead(t, 2) over o as t2
              from s join ends on ends.id = s.t where not done window o as (partition by w order by p)),
        a as (select n.w, n.p, n.t, m.id as m, behind.id as grown0, ahead.id as grown1
              from n left join merges m on n.t = m.l and n.t1 = m.r
                     left join behind on behind.k = ((n.tail00::bigint << 40) | (n.t0::bigint << 20) | n.t)
                     left join ahead on ahead.k = ((n.head3::bigint << 40) | (n.t1::bigint << 20) | n.t2)),
        b as (select *, lag(m) over o as m0, lead(m) over o as m1, min((m::bigint << 32) | p) over (partition by w) as best from a window o as (partition by w order by p)),
        c as (select *, coalesce(m <= coalesce(m1, m) and m <= coalesce(grown1, m) and m <= coalesce(m0, m) and m < coalesce(grown0, m + 1), false) or coalesce(m = best >> 32 and m not in (select id from solo), false) as free from b),
        r as (select *, row_number() over (partition by w order by p) - row_number() over (partition by w, free order by p) as run from c),
        f as (select *, row_number() over q as place, first_value(m0 is null or m0 > m) over q as sure from r window q as (partition by w, free, run order by p)),
        h as (select w, p, t, m, best is null as done,
                     coalesce(p = best & 4294967295, false) or (free and sure and place % 2 = 1) as take from f),
        g as (select *, coalesce(lag(take) over (partition by w order by p), false) as gone from h)
   select w, p, case when take then m else t end, done from g where not gone)
)
select w, t from s where done order by w, p
"""

DECODE_SQL = """
select d, string_agg(bytes, '') as text
from (select rows.d, rows.p, vocab.bytes from rows join vocab on vocab.id = rows.t order by rows.d, rows.p) group by d
"""


class IdTable:
    """Id lists of strings, in one array; it is emptied before it would hold more than `most` strings."""

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.at, self.length, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def missing(self, strings) -> set[str]:
        strings = set(strings)
        new = strings.difference(self.slots)
        if new and len(self.slots) + len(new) > self.most:
            self._clear()
            return strings
        return new

    def add(self, strings: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        self.slots.update(zip(strings, range(len(self.slots), len(self.slots) + len(strings)), strict=True))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(lengths) - lengths])
        self.length, self.flat = np.concatenate([self.length, lengths]), np.concatenate([self.flat, flat])

    def ids(self, slots) -> np.ndarray:
        s = np.array(slots, np.int64)
        n = self.length[s]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[s] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Bpe:
    """A vocabulary of ranks (tiktoken file: base64 bytes and rank in each line) with its merge table in DuckDB."""

    def __init__(self, ranks_path: str, pattern: str, most_words: int = 1_400_000, most_pieces: int = 700_000, memory: str = "300MB"):
        import regex

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.word_ids, self.piece_ids = IdTable(most_words), IdTable(most_pieces)
        self.db = duckdb.connect(config={"memory_limit": memory, "threads": 1, "temp_directory": local_dir("bpe-")})
        rows = [
            (self.ranks[t[:k]], self.ranks[t[k:]], i)
            for t, i in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        left, right, ids = (pa.array(c, pa.int32()) for c in zip(*rows, strict=True))
        merges = pa.table({"l": left, "r": right, "id": ids})  # noqa: F841  DuckDB finds it by name
        vocab = pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": [t.decode("latin-1") for t in self.ranks]})  # noqa: F841
        self.db.execute("create table merges as select * from merges")
        self.db.execute("create table vocab as select * from vocab")
        #: Whether two bytes stand next to each other in a token; between others no merge ever reaches.
        self.joined = np.zeros((256, 256), bool)
        for t in self.ranks:
            self.joined[list(t[:-1]), list(t[1:])] = True
        self.has_long_tables = False

    def _long_tables(self) -> None:
        """Tables that only long words need: what a neighbour may grow into, by it, its next byte and the token that waits."""
        self.has_long_tables = True
        tokens = {i: t for t, i in self.ranks.items()}
        ahead: dict[int, int] = {}
        behind: dict[int, int] = {}
        for l, r, i in self.db.execute("select l, r, id from merges").fetchall():
            left, right = tokens[l], tokens[r]
            for k in range(1, len(right)):
                if (part := self.ranks.get(right[:k])) is not None:
                    key = right[k] << 40 | l << 20 | part
                    ahead[key] = min(i, ahead.get(key, i))
            for k in range(1, len(left)):
                if (part := self.ranks.get(left[k:])) is not None:
                    key = left[k - 1] << 40 | part << 20 | r
                    behind[key] = min(i, behind.get(key, i))
        for name, found in (("ahead", ahead), ("behind", behind)):
            rows = pa.table({"k": pa.array(found.keys(), pa.int64()), "id": pa.array(found.values(), pa.int32())})  # noqa: F841
            self.db.execute(f"create table {name} as select * from rows")
        rows = pa.table({"id": pa.array(tokens.keys(), pa.int32()), "head": [t[0] for t in tokens.values()], "tail": [t[-1] for t in tokens.values()]})  # noqa: F841
        self.db.execute("create table ends as select id, head::int as head, tail::int as tail from rows")
        self.db.execute("create table solo as select distinct t as id from (select l as t, id from merges union all select r, id from merges) where id < t")

    def merge(self, words: list[str], block_bytes: int = 500_000) -> None:
        """Puts the ids of new words into the table of words; words that are a token as a whole need no merging."""
        block, size, whole = [], 0, []
        for w in words:
            raw = w.encode()
            if raw in self.ranks:
                whole.append(w)
            elif len(raw) > 256:
                ids = self._long_ids(raw, block_bytes)
                self.word_ids.add([w], np.array([len(ids)]), ids)
            else:
                block.append((w, raw))
                size += len(raw)
            if size >= block_bytes:
                self._merge_block(block)
                block, size = [], 0
        if block:
            self._merge_block(block)
        self.word_ids.add(whole, np.ones(len(whole), np.int64), np.array([self.ranks[w.encode()] for w in whole], np.uint32))

    def _merge_block(self, block: list[tuple[str, bytes]]) -> None:
        self.word_ids.add([w for w, _ in block], *self._merged([r for _, r in block], ENCODE_SQL))

    def _merged(self, words: list[bytes], sql: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the words' ids, and all ids one after the other."""
        lens = np.array([len(r) for r in words])
        first = np.repeat(np.cumsum(lens) - lens, lens)
        t = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        w, p = np.repeat(np.arange(len(words), dtype=np.int64), lens), np.arange(len(t)) - first
        start = pa.table({"g": w << 8 | p, "w": w.astype(np.int32), "p": p, "t": t})  # noqa: F841
        out = self.db.execute(sql).fetchnumpy()
        return np.bincount(out["w"], minlength=len(words)), out["t"].astype(np.uint32)

    def _long_ids(self, raw: bytes, block_bytes: int) -> np.ndarray:
        """Ids of a long word: it is cut where no token reaches across, each different part is merged once."""
        b = np.frombuffer(raw, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.joined[b[:-1], b[1:]]) + 1).tolist(), len(raw)]
        parts = [raw[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]
        known: dict[bytes, np.ndarray] = {}
        short: list[bytes] = []
        for part in dict.fromkeys(parts):
            if len(part) <= 256:
                short.append(part)
            else:
                if not self.has_long_tables:
                    self._long_tables()
                known[part] = self._merged([part], ENCODE_LONG_SQL)[1]
        at = 0
        while at < len(short):
            size, lo = 0, at
            while at < len(short) and size < block_bytes:
                size += len(short[at])
                at += 1
            lengths, ids = self._merged(short[lo:at], ENCODE_SQL)
            known.update(zip(short[lo:at], np.split(ids, np.cumsum(lengths)[:-1]), strict=True))
        return np.concatenate([known[part] for part in parts])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, as unsigned 32-bit integers.

        A space that a visible character follows starts a match of the pattern whatever stands before it, so texts are cut
        there first; only new pieces are matched. Texts with other spaces are matched as a whole.
        """
        cut = [t.replace(" ", "\0 ").split("\0") if "\0" not in t else [t] for t in texts]
        new = self.piece_ids.missing(chain.from_iterable(cut))
        self._match([p for p in new if self._starts_match(p)], self.piece_ids)
        get = self.piece_ids.slots.get
        found = [list(map(get, ps)) for ps in cut]
        odd = [i for i, slots in enumerate(found) if None in slots]
        whole = IdTable(len(odd))
        self._match(list({texts[i] for i in odd}), whole)
        return [whole.ids([whole.slots[t]]) if None in slots else self.piece_ids.ids(slots) for t, slots in zip(texts, found, strict=True)]

    @staticmethod
    def _starts_match(piece: str) -> bool:
        return piece[:1] != " " or (len(piece) > 1 and not piece[1].isspace())

    def _match(self, pieces: list[str], into: IdTable) -> None:
        """Puts the ids of pieces into a table, word by word."""
        if not pieces:
            return
        cut = [self.words(p) for p in pieces]
        flat = list(chain.from_iterable(cut))
        if new := self.word_ids.missing(flat):
            self.merge(list(new))
        slots = np.fromiter(map(self.word_ids.slots.__getitem__, flat), np.int64, len(flat))
        ends = np.concatenate([[0], np.cumsum(self.word_ids.length[slots])])
        last = np.cumsum([len(c) for c in cut])
        into.add(pieces, np.diff(ends[np.concatenate([[0], last])]), self.word_ids.ids(slots))

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of every id list."""
        lens = [len(x) for x in ids]
        if not sum(lens):
            return [b""] * len(ids)
        total = sum(lens)
        rows = pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), lens), "p": np.arange(total, dtype=np.int32), "t": np.concatenate(ids).astype(np.int32)})  # noqa: F841
        found = self.db.sql(DECODE_SQL).to_arrow_table()
        out = [b""] * len(ids)
        for d, h in zip(found["d"].to_pylist(), found["text"].to_pylist(), strict=True):
            out[d] = h.encode("latin-1")
        return out


_LOADED: dict[tuple, Bpe] = {}


def bpe(ranks_path: str, pattern: str) -> Bpe:
    """One per worker process, so the cache of merged words outlives a task."""
    if (ranks_path, pattern) not in _LOADED:
        _LOADED[ranks_path, pattern] = Bpe(ranks_path, pattern)
    return _LOADED[ranks_path, pattern]


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, ids array<int>: the byte-level BPE ids of every whole text, without special tokens.

    Map-only. Null or empty text: no ids. Null ids and repeated rows are kept row by row. A word of any length is merged
    as a whole; the worker's bounded tables of words only save time.
    """
    return _run(docs, ranks_path, pattern, id_col, text_col, "ids array<int>", lambda b, ids: [pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))])


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Columns id_col, bytes binary of id lists; a null list counts as empty, ids outside the vocabulary give no bytes."""
    id_type = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = bpe(ranks_path, pattern)
        for b in batches:
            ids = [np.asarray(x or [], np.int64) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(coder.decode(ids), pa.binary())], names=["id", "bytes"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"id {id_type}, bytes binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id_col, n_tokens, ids_sha256, decoded_sha256: encodes as encode_texts and decodes as decode_ids in one pass."""

    def digests(coder: Bpe, ids: list[np.ndarray]) -> list[pa.Array]:
        sha = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
        back = [hashlib.sha256(x).hexdigest() for x in coder.decode(ids)]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(sha), pa.array(back)]

    return _run(docs, ranks_path, pattern, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _run(docs, ranks_path, pattern, id_col, text_col, schema, make) -> DataFrame:
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        coder = bpe(ranks_path, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = coder.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), *make(coder, ids)], names=names)

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, {schema}").withColumnRenamed("id", id_col)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
