"""Many literal patterns in many texts: Aho-Corasick automata, built by Spark tasks for blocks of patterns, and windows.

A block holds patterns of bounded length in all; a task builds its automaton (a trie whose nodes know where matching goes on
when a letter does not fit) and writes it into a shared folder, under a temporary name first. Tasks that scan texts load the
automata they need and pass each text through each once, so the work is linear in the text for each block, however many
patterns the block has.

Where only the patterns that texts hold are asked for (`present`), lengths with so many patterns that they would take blocks of
their own are looked up by windows instead: a running sum gives the hashes of all windows of a length, and a table of hashes
tells which may be patterns. A text is passed once for each such length, so the work doesn't grow with texts times patterns.
"""

from __future__ import annotations

import pickle
import posixpath
import uuid
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import filesystem

#: Characters of patterns in an automaton, which takes some fifty bytes for each, and automata that a worker holds.
BLOCK_CHARS, HELD = 1 << 20, 4
#: Characters of texts that meet all automata before the next.
TEXT_CHARS = 8 << 20
#: Patterns that a task remembers to have named.
NAMED = 1 << 20
#: Hashes in a file of a table, bits of a file for each hash, and bytes of files that a worker holds of a store that is not mounted.
SHARD, SPARSE, HELD_BYTES = 1 << 21, 16, 256 << 20
#: Places of texts whose windows are hashed at once.
PLACES = 1 << 19
#: A code that no character has: it stands between texts.
BETWEEN = 0x110000
_BASE, _FIRST = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


@dataclass(frozen=True)
class Matcher:
    """The automata below a folder, and, by length, how many files the table of the hashes of patterns of that length has, as a
    power of two."""

    path: str
    blocks: int
    lengths: tuple[tuple[int, int], ...] = ()


def build(patterns: DataFrame, path: str, pattern: str = "pattern", block_chars: int = BLOCK_CHARS, windows: bool = False) -> Matcher:
    """Automata of the distinct patterns of a column; null and empty ones match nothing. With windows, which serve `present`
    alone, lengths whose patterns have over block_chars characters in all get tables of hashes."""
    distinct = patterns.select(F.col(pattern).alias("pattern")).filter("pattern <> ''").distinct()
    sizes = distinct.groupBy(F.length("pattern").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length
    many = {r.length: r.n for r in sizes if windows and r.length * r.n > block_chars}
    lengths = tuple((d, max(0, (n // SHARD).bit_length())) for d, n in sorted(many.items()))
    if lengths:
        _save_tables(distinct, lengths, path)
        distinct = distinct.filter(~F.length("pattern").isin(list(many)))
    blocks = sum(r.length * r.n for r in sizes if r.length not in many) // block_chars + 1

    def make(table: pa.Table) -> pa.Table:
        machine = ahocorasick.Automaton()
        for word in table.column("pattern").to_pylist():
            machine.add_word(word, word)
        machine.make_automaton()
        number = table.column("block")[0].as_py()
        store, folder = filesystem(path)
        store.create_dir(folder, recursive=True)
        part = posixpath.join(folder, f"{uuid.uuid4().hex}.part")
        with store.open_output_stream(part) as f:
            f.write(pickle.dumps(machine, protocol=5))
        store.move(part, posixpath.join(folder, f"{number}.automaton"))
        return pa.table({"block": pa.array([number], pa.int64()), "patterns": pa.array([len(table)], pa.int64())})

    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("pattern"), F.lit(blocks)))
    dealt.groupBy("block").applyInArrow(make, "block long, patterns long").write.parquet(f"{path}/blocks")  # BLOCK_CHARS a group
    return Matcher(path, blocks, lengths)


class Windows:
    """Hashes of all windows of texts, given as codes of characters one after the other: sums of codes times powers, divided by
    the power of the window's first place."""

    _powers = np.zeros((2, 0), np.uint64)

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            self.codes, self.between = codes, np.append(np.flatnonzero(codes == BETWEEN), len(codes))
            if Windows._powers.shape[1] < len(codes):
                ups, downs = np.full(len(codes), _BASE, np.uint64), np.full(len(codes), pow(_BASE, -1, 1 << 64), np.uint64)
                ups[0], downs[0] = _FIRST, 1
                Windows._powers = np.stack([np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)])
            self.sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * Windows._powers[0, : len(codes)], out=self.sums[1:])

    def hashes(self, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = max(0, len(self.codes) - length + 1)
            return (self.sums[length : length + n] - self.sums[:n]) * Windows._powers[1, :n]

    def inside(self, places: np.ndarray, length: int) -> np.ndarray:
        """Places whose windows lie in one text."""
        return places[self.between[np.searchsorted(self.between, places)] >= places + length]


def codes_of(texts: list[str]) -> np.ndarray:
    """Codes of the characters of texts, with BETWEEN behind each."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    out = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le"), np.uint32).copy()
    out[ends - 1] = BETWEEN
    return out


def hash_of(texts: list[str], length: int) -> np.ndarray:
    """Hashes of texts of one length."""
    return Windows(codes_of(texts)).hashes(length)[:: length + 1]


def _file(path: str, length: int, shard: int) -> str:
    return f"{path}/length-{length}-{shard}.hashes"


def _save_tables(distinct: DataFrame, lengths: tuple[tuple[int, int], ...], path: str) -> None:
    """Tables of the patterns' hashes by length: files of ranges of the hash, each with the number of its hashes, the
    logarithm of the number of its bits, these, and the hashes in order."""
    power = dict(lengths)

    def hashed(batches):
        for b in batches:
            by_length: dict[int, list[str]] = {}
            for word in b.column("pattern").to_pylist():
                by_length.setdefault(len(word), []).append(word)
            for d, words in by_length.items():
                if d in power:
                    for lo in range(0, len(words), max(1, PLACES // (d + 1))):
                        h = hash_of(words[lo : lo + max(1, PLACES // (d + 1))], d)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), d, np.int32)), pa.array(_top(h, power[d]).astype(np.int32)), pa.array(h.view(np.int64))], names=["length", "shard", "hash"])

    def write(key, table):
        d, shard = key[0].as_py(), key[1].as_py()
        keys = np.unique(table.column("hash").to_numpy().view(np.uint64))
        bits = max(3, (len(keys) * SPARSE).bit_length())
        marks = np.zeros(1 << bits, np.uint8)
        marks[_slot(keys, power[d], bits)] = 1
        store, name = filesystem(_file(path, d, shard))
        store.create_dir(posixpath.dirname(name), recursive=True)
        part = f"{name}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            f.write(np.array([len(keys), bits], np.int64).tobytes() + keys.tobytes() + np.packbits(marks, bitorder="little").tobytes())
        store.move(part, name)
        return pa.table({"hashes": pa.array([len(keys)], pa.int64())})

    rows = distinct.mapInArrow(hashed, "length int, shard int, hash long")
    rows.groupBy("length", "shard").applyInArrow(write, "hashes long").write.parquet(f"{path}/tables")  # about SHARD hashes a group


def _top(hashes: np.ndarray, power: int) -> np.ndarray:
    """The file that holds a hash, of 2 ** power."""
    return hashes >> np.uint64(64 - power) if power else np.zeros(len(hashes), np.uint64)


def _slot(hashes: np.ndarray, power: int, bits: int) -> np.ndarray:
    return (hashes << np.uint64(power)) >> np.uint64(64 - bits)


_TABLES: OrderedDict[str, tuple[np.ndarray, np.ndarray, int]] = OrderedDict()


def _table(uri: str) -> tuple[np.ndarray, np.ndarray, int] | None:
    """The hashes, bits and logarithm of a file; files of a mounted store are mapped."""
    if uri not in _TABLES:
        store, name = filesystem(uri)
        if not store.get_file_info(name).is_file:
            return None
        if store.type_name == "local":
            raw = np.memmap(name, np.uint8, "r").view(np.ndarray)
        else:
            with store.open_input_stream(name) as f:
                raw = np.frombuffer(f.read(), np.uint8)
        n, bits = raw[:16].view(np.int64).tolist()
        _TABLES[uri] = raw[16 : 16 + 8 * n].view(np.uint64), raw[16 + 8 * n :], bits
        while len(_TABLES) > 1 and sum(t[0].nbytes + t[1].nbytes for u, t in _TABLES.items() if filesystem(u)[0].type_name != "local") > HELD_BYTES:
            _TABLES.popitem(last=False)
    return _TABLES[uri]


def _held(hashes: np.ndarray, table: tuple[np.ndarray, np.ndarray, int] | None, power: int) -> np.ndarray:
    """Places of hashes that a table's file holds."""
    if table is None:
        return np.zeros(0, np.int64)
    keys, marks, bits = table
    slot = _slot(hashes, power, bits)
    maybe = np.flatnonzero((marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
    at = np.minimum(np.searchsorted(keys, hashes[maybe]), len(keys) - 1)
    return maybe[keys[at] == hashes[maybe]]


def windows_held(matcher: Matcher, texts: list[str]) -> Iterator[bytes]:
    """Windows of texts whose hash is that of a pattern of their length: all patterns with tables that the texts hold. Another
    text of the same hash may be among them, which comparing tells."""
    codes = codes_of(texts)
    most = max(d for d, _ in matcher.lengths)
    for lo in range(0, len(codes), PLACES):
        part = Windows(codes[lo : lo + PLACES + most - 1])
        raw = part.codes.tobytes()
        for d, power in matcher.lengths:
            hashes = part.hashes(d)
            if power:
                file = _top(hashes, power).astype(np.uint16)
                order = np.argsort(file, kind="stable")
                ends = np.searchsorted(file[order], np.arange((1 << power) + 1))
                shards = [order[a:b] for a, b in zip(ends, ends[1:])]
                places = np.concatenate([own[_held(hashes[own], _table(_file(matcher.path, d, i)), power)] for i, own in enumerate(shards)])
            else:
                places = _held(hashes, _table(_file(matcher.path, d, 0)), 0)
            yield from {raw[4 * p : 4 * (p + d)] for p in part.inside(np.sort(places), d).tolist()}


_LOADED: OrderedDict[str, object] = OrderedDict()


def load(uri: str):
    """An automaton of the shared folder, or None for a block without patterns; a worker keeps the last few."""
    if uri in _LOADED:
        _LOADED.move_to_end(uri)
        return _LOADED[uri]
    store, path = filesystem(uri)
    machine = None
    if store.get_file_info(path).is_file:
        with store.open_input_stream(path) as f:
            machine = pickle.loads(f.read())
    _LOADED[uri] = machine
    while len(_LOADED) > HELD:
        _LOADED.popitem(last=False)
    return machine


def pieces(texts: pa.Array) -> Iterator[tuple[int, list]]:
    """Runs of texts of about TEXT_CHARS, with the place of their first."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts.to_pylist()):
        held.append(text)
        size += len(text or "")
        if size >= TEXT_CHARS:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def machines(matcher: Matcher):
    return (m for block in range(matcher.blocks) if (m := load(f"{matcher.path}/{block}.automaton")) is not None)


def occurrences(docs: DataFrame, matcher: Matcher, key: str, text: str = "text") -> DataFrame:
    """key, pattern, n: how often each document holds each pattern, overlapping occurrences counted; no row without any."""

    def run(batches):
        for b in batches:
            for lo, texts in pieces(b.column("text")):
                for machine in machines(matcher):
                    rows = [(lo + i, Counter(w for _, w in machine.iter(t))) for i, t in enumerate(texts) if t]
                    places = [i for i, counts in rows for _ in counts]
                    if places:
                        words, n = zip(*(x for _, counts in rows for x in counts.items()), strict=True)
                        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(places)), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["key", "pattern", "n"])

    own = docs.schema[key].dataType.simpleString()
    found = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {own}, pattern string, n long")
    return found.withColumnRenamed("key", key)


def present(docs: DataFrame, matcher: Matcher, text: str = "text") -> DataFrame:
    """pattern: every pattern that some text holds. A task names each about once, so little is shuffled. Of a matcher with
    windows, a text of the hash of a pattern may be among them: the caller joins them with the patterns."""

    def run(batches):
        known: set = set()
        for b in batches:
            for _, texts in pieces(b.column("text")):
                texts = [t for t in texts if t]
                found = [{w for t in texts for _, w in machine.iter(t)} for machine in machines(matcher)]
                if matcher.lengths and texts:
                    found.append({w.decode("utf-32-le") for w in windows_held(matcher, texts)})
                for words in found:
                    new = words - known
                    if new:
                        known = known | new if len(known) < NAMED else new
                        yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.string())], names=["pattern"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern string").distinct()
