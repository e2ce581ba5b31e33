"""Fill-in-middle transformation: cuts of a text by run-length class encoding.

A text's UTF-8 bytes are kept as maximal runs of one character class (characters of one encoded width), each with the
number of units (code points) before it. The run that holds a cut is found by binary search, and the cut's byte is
computed from the run's start and width: no text is walked character by character, and a batch of texts shares one table
of runs.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, table, text_of

SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of text whose runs are computed at once; a longer text is a slice of its own.
SLICE = 4 << 20
#: Encoded width of the character that a byte starts; 0 inside a character.
WIDTH = np.array([1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)], np.uint8)


@dataclass(frozen=True)
class Runs:
    """Maximal runs of characters of one width: first byte, units before the run, width; and the units of all."""

    first_byte: np.ndarray
    first_unit: np.ndarray
    width: np.ndarray
    units: int

    @classmethod
    def of(cls, data: np.ndarray) -> Runs:
        if not len(data):
            zero = np.zeros(1, np.int64)
            return cls(zero, zero, np.ones(1, np.int64), 0)
        width = WIDTH[data]
        before = np.empty_like(width)
        before[0], before[1:] = 0, width[:-1]
        # Only characters beside others than ASCII can start a run; the width before one is that of the byte before it, or, behind
        # a longer character, that of the place before in this list, which is where that character starts.
        places = np.flatnonzero((width != 0) & ((width != 1) | (before != 1)))
        if not len(places):  # no character starts here
            zero = np.zeros(1, np.int64)
            return cls(zero, zero, np.ones(1, np.int64), 0)
        own = width[places]
        last = np.empty_like(own)
        last[0], last[1:] = 0, own[:-1]
        last = np.where(before[places] == 1, 1, last)
        starts = places[own != last].astype(np.int64)
        widths = width[starts].astype(np.int64)
        counts = np.diff(np.append(starts, len(data))) // widths
        return cls(starts, np.cumsum(counts) - counts, widths, int(counts.sum()))

    def unit_at(self, byte: np.ndarray) -> np.ndarray:
        """Units before bytes that start characters, or before the end."""
        run = np.maximum(np.searchsorted(self.first_byte, byte, "right") - 1, 0)
        return np.minimum(self.first_unit[run] + (byte - self.first_byte[run]) // self.width[run], self.units)

    def byte_at(self, unit: np.ndarray) -> np.ndarray:
        """The byte where a unit starts; the end for the number of all units."""
        run = np.maximum(np.searchsorted(self.first_unit, unit, "right") - 1, 0)
        return self.first_byte[run] + (unit - self.first_unit[run]) * self.width[run]


def draws(seed: str, doc_id) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits, drawn from the id alone; a null id counts as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """They must share a first character that occurs nowhere else in them: then none can arise across the ends of two pieces."""
    first = {s[:1] for s in sentinels}
    if len(set(sentinels)) != 3 or len(first) != 1 or "" in first or any(first & set(s[1:]) for s in sentinels):
        raise ValueError("sentinels must be three texts with one first character that is nowhere else in them")


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "1",
    plain_percent: int = 10,
    spm_percent: int = 20,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, output: one row per input row, map-only.

    Two cuts among the n + 1 places of a text's n code points, drawn from the id, give prefix, middle and suffix. Texts that
    are empty (null counts as empty) or hold a sentinel stay plain, as do plain_percent of the rest; of the others spm_percent
    are written suffix first. Counts are null for plain texts. Null ids count as empty text in the draw. Repeated rows are
    kept row by row; other columns of any name are dropped; an empty table gives an empty result. A text of any length is
    cut whole.
    """
    check_sentinels(sentinels)
    marks = tuple(s.encode() for s in sentinels)
    before, behind, middle_mark = marks

    def one(doc_id, raw: bytes, numbers) -> tuple[str, int, int]:
        """Form, first and second cut."""
        h1, h2, h3, h4, n = numbers
        if not raw or h3 % 100 >= 100 - plain_percent or any(m in raw for m in marks):
            return PLAIN, 0, 0
        return (SPM if h4 % 100 < spm_percent else PSM), *sorted((h1 % (n + 1), h2 % (n + 1)))

    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE):
                ids, texts = part.column("id").to_pylist(), part.column("text").cast(pa.binary())
                ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
                ends -= ends[0]
                runs = Runs.of(data)
                at = runs.unit_at(ends)
                n = np.diff(at)
                raws = [data[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                chosen = [one(i, raw, (*draws(seed, i), k)) for i, raw, k in zip(ids, raws, n.tolist(), strict=True)]
                cuts = runs.byte_at(np.array([c[1:] for c in chosen], np.int64).reshape(-1, 2) + at[:-1, None]) - ends[:-1, None]
                out = []
                for raw, (form, _, _), (a, b) in zip(raws, chosen, cuts.tolist(), strict=True):
                    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
                    out.append(
                        raw if form == PLAIN
                        else b"".join((before, prefix, behind, suffix, middle_mark, middle)) if form == PSM
                        else b"".join((behind, suffix, before, prefix, middle_mark, middle))
                    )
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array(n, pa.int64()),
                        pa.array([c[0] for c in chosen], pa.string()),
                        pa.array([None if c[0] == PLAIN else c[1] for c in chosen], pa.int64()),
                        pa.array([None if c[0] == PLAIN else c[2] - c[1] for c in chosen], pa.int64()),
                        pa.array(out, pa.binary()),
                    ],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    made = rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string")).withColumnRenamed("id", id_col)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of an output, from it and its form alone, in the JVM."""
    p, s, m = (F.lit(x) for x in sentinels)

    def from_start(c: Column, mark: str) -> Column:
        return c.substr(F.lit(len(mark) + 1), F.length(c))

    first = from_start(F.split_part(output, s, F.lit(1)), sentinels[0])
    rest = F.split_part(output, s, F.lit(2))
    suffix_first = from_start(F.split_part(output, p, F.lit(1)), sentinels[1])
    rest_spm = F.split_part(output, p, F.lit(2))
    psm = F.concat(first, F.split_part(rest, m, F.lit(2)), F.split_part(rest, m, F.lit(1)))
    spm = F.concat(F.split_part(rest_spm, m, F.lit(1)), F.split_part(rest_spm, m, F.lit(2)), suffix_first)
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


OP11_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
r as (select doc_id, t, length(t) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from r),
p as (select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256 from p
"""
