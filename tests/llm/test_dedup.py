import hashlib
import random
from collections import Counter, defaultdict

import pytest

from spindrift.llm import exact_dedup, near_dedup

from .helpers import LOW, ODD, SMALL, documents, words


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_groups(spark, digest_bytes):
    random.seed(1)
    rows = [r for r in ODD if r[0] is not None] + [(100 + i, random.choice(["a", "A", "b c", "B C", "", None, f"u{i}"])) for i in range(300)]
    got = exact_dedup.exact_duplicates(documents(spark, rows), memtable_rows=50, shard_rows=60, digest_bytes=digest_bytes).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOW)].append(i)
    expected = Counter((i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == expected
    smallest = exact_dedup.exact_duplicates(documents(spark, rows), keep="smallest").filter("kept").count()
    assert smallest >= len(groups)


def test_exact_edges(spark):
    assert exact_dedup.exact_duplicates(documents(spark, [])).count() == 0
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(documents(spark, [(None, "x"), (3, "X"), (None, "y")])).collect()}
    assert got == {(None, 3, False), (3, 3, True), (None, None, True)}
    kept = exact_dedup.drop_exact_duplicates(documents(spark, [(1, "x"), (2, "X"), (None, "x")]))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "None"] and "score" in kept.columns


def brute(rows, width, percent=80):
    sets = {i: frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if (w := words(t)) else frozenset() for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for s in sets[i] for j in lists[s])
        for s in sets[i]:
            lists[s].append(i)
        for j, m in shared.items():
            if 100 * m >= percent * (len(sets[i]) + len(sets[j]) - m):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def families(seed, n):
    """Near copies by random edits, passages that many share, short texts, copies."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + str(rnd.randint(0, 400))
    passage, rows = [word() for _ in range(60)], []
    for _ in range(n):
        base = [word() for _ in range(rnd.randint(3, 150))]
        if rnd.random() < 0.4:
            base[5:5] = passage
        for _ in range(rnd.choice([1, 1, 2, 5, 30])):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(own) // 25))):
                own[rnd.randrange(len(own))] = word()
            rows.append((len(rows) * 3, " ".join(own)))
    return rows


@pytest.mark.parametrize("options", [{}, {"short_list": 4, "block": 10}])
def test_near_components_are_those_of_brute_force(spark, options):
    rows = families(3, 60) + [(1, None), (2, ""), (4, "one"), (5, "ONE"), (7, "two words")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents(spark, rows), width=4, **options).collect()}
    assert got == brute(rows, 4)


def test_near_edges(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.near_duplicates(documents(spark, [(None, "a b c"), (8, "A b c"), (None, "z"), (None, None)])).collect())
    assert got == [("8", "8", True), ("None", "8", False), ("None", "None", True), ("None", "None", True)]
    kept = near_dedup.drop_near_duplicates(documents(spark, families(4, 5)))
    assert kept.count() == sum(k for _, _, k in brute(families(4, 5), 5).values())


def test_near_query_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.op8_near_dedup(spark, SMALL).collect()}
    assert got == brute(rows, 4)
