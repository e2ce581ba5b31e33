"""Query expansion with a table of names of any size: what expand.Expander does for a glossary, as Spark jobs.

The names' automata are built by blocks (operators.patterns); a query passes through each once, and the names it holds claim
their characters, the longest first, so that no two overlap. What the names stand for is joined to the claims afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import has_cjk, normalize
from . import patterns
from .expand import MOST

#: First characters by which names are told that no query holds, and beginnings in queries up to which these are broadcast.
BEGIN, MOST_HELD = 12, 2_000_000


def entries(glossary: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """number, kind, name, gives: aliases (kind 0) of glossary entries (canonical, aliases, identifiers) and phrases (kind 1,
    phrase, concepts), names normalised. Numbers grow in the order of the rows and of the aliases in them."""
    given = F.concat(F.array("canonical"), F.coalesce("identifiers", F.array().cast("array<string>")))
    own = glossary.withColumn("at", F.monotonically_increasing_id()).select("at", F.posexplode("aliases").alias("i", "alias"), given.alias("gives"))
    rows = own.select(F.struct("at", "i").alias("number"), F.lit(0).alias("kind"), normalize(F.col("alias")).alias("name"), "gives")
    if phrases is not None:
        more = phrases.withColumn("at", F.monotonically_increasing_id())
        rows = rows.unionByName(more.select(F.struct("at", F.lit(0).alias("i")).alias("number"), F.lit(1).alias("kind"), F.col("phrase").alias("name"), F.col("concepts").alias("gives")))
    return rows.filter("name <> ''")


def claim(text: str, found: list[tuple[tuple, str, list[int]]]) -> list[tuple]:
    """The entries that get a place, in order. found: (kind, number) of each entry with its name and the name's places; the
    longest names of a kind come first, and each takes its first place that none before has touched."""
    taken, out = bytearray(len(text)), []
    left: dict[str, Iterator[int]] = {}  # a name's places that no entry has looked at; those before stay taken
    for key, name, places in sorted(found, key=lambda x: (x[0][0], -len(x[1]), x[0][1])):
        at = next((p for p in left.setdefault(name, iter(places)) if not any(taken[p : p + len(name)])), None)
        if at is not None:
            taken[at : at + len(name)] = b"\1" * len(name)
            out.append(key)
    return out


def possible(asked: DataFrame, names: DataFrame) -> DataFrame:
    """The names whose first BEGIN characters (all, of shorter ones) some query (text, normalised) holds. No other name can be in
    a query, so what is written of names grows with what the queries hold, not with the names."""
    ends = F.explode(F.sequence(F.lit(1), F.lit(BEGIN))).alias("n")
    cut = asked.filter("text <> ''").select("text", ends).filter(F.length("text") >= F.col("n"))
    parts = cut.select("n", F.explode(F.sequence(F.lit(1), F.length("text") - F.col("n") + 1)).alias("i"), "text")
    held = parts.select(F.xxhash64(F.col("text").substr(F.col("i"), F.col("n"))).alias("_begin")).distinct()
    few = held.limit(MOST_HELD + 1).count() <= MOST_HELD
    begin = F.xxhash64(F.col("name").substr(1, BEGIN))
    return names.withColumn("_begin", begin).join(F.broadcast(held) if few else held, "_begin", "left_semi").drop("_begin")


def expand(queries: DataFrame, names: DataFrame, path: str) -> DataFrame:
    """query_id, text: normalised queries (query_id unique, text) with at most MOST additions, as Expander gives them. names:
    number (of any type that has an order, unique within a kind), kind, name (normalised), gives. Null queries stay null.

    Names are any number: their automata and numbers lie below a shared folder. Phrases are for queries with CJK characters.
    """
    spark = queries.sparkSession
    asked = queries.select("query_id", normalize(F.col("text")).alias("text"))
    asked.write.parquet(f"{path}/queries")
    asked = spark.read.parquet(f"{path}/queries")
    names = possible(asked, names)
    # Entries of one name claim places in the order of their numbers, so no more than there are places in a query can get one.
    longest = asked.agg(F.max(F.length("text"))).first()[0] or 0
    nth = Window.partitionBy("name", "kind").orderBy("number")  # cut before it is shuffled
    few = names.filter("name <> ''").withColumn("_nth", F.row_number().over(nth)).filter(F.col("_nth") <= longest).filter(F.col("_nth") * F.length("name") <= longest)
    ranked = few.select("name", "kind", "_nth", "number", "gives")
    ranked.write.parquet(f"{path}/names")
    stored = spark.read.parquet(f"{path}/names")
    matcher = patterns.build(stored.select("name"), path, "name")

    def places(batches):
        for b in batches:
            for lo, texts in patterns.pieces(b.column("text")):
                for machine in patterns.machines(matcher):
                    held = [(lo + i, end - len(w) + 1, w) for i, t in enumerate(texts) if t for end, w in machine.iter(t)]
                    if held:
                        at, start, words = zip(*held, strict=True)
                        yield pa.RecordBatch.from_arrays([b.column("query_id").take(pa.array(at)), pa.array(start, pa.int32()), pa.array(words, pa.string())], names=["query_id", "start", "name"])

    kind = queries.schema["query_id"].dataType.simpleString()
    found = asked.mapInArrow(places, f"query_id {kind}, start int, name string")
    spots = found.groupBy("query_id", "name").agg(F.sort_array(F.collect_list("start")).alias("places"))  # of one query
    first = F.col("_nth") == 1  # places and text travel with a name's first entry alone
    claiming = spots.join(stored.select("name", "kind", "number", "_nth"), "name").filter(F.col("_nth") <= F.size("places"))
    claiming = claiming.withColumn("places", F.when(first, F.col("places")))
    held = claiming.join(asked, "query_id").filter((F.col("kind") == 0) | has_cjk(F.col("text"))).withColumn("text", F.when(first, F.col("text")))
    # Names of one query meet in a task: as many as its text holds. Numbers travel as places in their order.
    order = Window.partitionBy("query_id", "kind").orderBy("number")
    numbered = held.withColumn("_n", F.row_number().over(order))

    def claims(key, table):
        columns = (table.column(c).to_pylist() for c in ("name", "kind", "_n", "places", "text"))
        rows = list(zip(*columns, strict=True))
        where = {name: places for name, _, _, places, _ in rows if places is not None}
        text = next(t for *_, t in rows if t is not None)
        out = [(key[0].as_py(), i, k, n) for i, (k, n) in enumerate(claim(text, [((k, n), name, where[name]) for name, k, n, _, _ in rows]))]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.array(columns[0], key[0].type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int32())], names=["query_id", "turn", "kind", "_n"])

    won = numbered.select("query_id", "name", "kind", "_n", "places", "text").groupBy("query_id").applyInArrow(claims, f"query_id {kind}, turn int, kind int, _n int")
    given = won.join(numbered.select("query_id", "kind", "_n", "name", "_nth"), ["query_id", "kind", "_n"]).join(stored.select("name", "kind", "_nth", "gives"), ["name", "kind", "_nth"])
    turns = given.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("turn", "gives"))).alias("turns"))
    added = turns.select("query_id", F.slice(F.array_distinct(F.flatten(F.transform("turns", lambda x: x["gives"]))), 1, MOST).alias("added"))
    text = F.when(F.col("text").isNotNull(), F.trim(F.concat_ws(" ", F.col("text"), F.col("added"))))
    return asked.join(added, "query_id", "left").select("query_id", text.alias("text"))
