import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import fim

from .helpers import ODD, SMALL, documents

MORE = [(20 + i, t) for i, t in enumerate(["a<P>b", "x<S>", "<M>", "<P", "P><S", "é", "日本語 text 𝄞𝄞 é" * 9, "a" * 100_000 + "é" * 3, "<<<<", ">>S>P>"])]


def expected(doc_id, text, plain=10, spm=20):
    """The contract, character by character."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= 100 - plain:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    back = fim.restored(F.col("output"), F.col("form")).alias("back")
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in df.select("*", back).collect()), key=str)


@pytest.mark.parametrize("plain, spm", [(10, 20), (0, 100), (0, 0), (100, 50)])
def test_every_text_is_cut_as_the_contract_says(spark, plain, spm):
    rows = ODD + MORE + [(100 + i, "".join(random.Random(i).choices("ab<PSM> é漢𝄞\n\0", k=i))) for i in range(200)]
    got = rows_of(fim.fill_in_middle(documents(spark, rows), plain_percent=plain, spm_percent=spm))
    assert got == sorted(((i is None, i or 0, *expected(i, t, plain, spm), t or "") for i, t in rows), key=str)


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {(r.doc_id, *(e := expected(r.doc_id, r.text))[:4], sha(e[4]), sha(r.text or "")) for r in docs}
    got = fim.op11_fill_in_middle(spark, SMALL).collect()
    assert len(got) == len(docs) and {tuple(r) for r in got} == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_bad_sentinels(spark):
    assert fim.fill_in_middle(documents(spark, ODD).limit(0)).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "[S]", "<M>"), ("<P", "<<", "<M"), ("", "a", "b")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(documents(spark, ODD), sentinels=bad)


@given(st.text(alphabet="ab é漢𝄞\0", max_size=40))
@settings(max_examples=200, deadline=None)
def test_runs(text):
    data = np.frombuffer(text.encode(), np.uint8)
    runs = fim.Runs.of(data)
    assert runs.units == len(text)
    places = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    units = np.arange(len(text) + 1)
    assert runs.byte_at(units).tolist() == places.tolist()
    assert runs.unit_at(places).tolist() == units.tolist()
