from spindrift.operators.ingest import fence_gates


def test_fence_gates_count_lines(spark):
    text = "`python\nx `y` z\n`\n```cpp\na\n```\n~~~\nread .agents/a\n You are an expert in x\n`c \n"
    rows = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in fence_gates(rows, "doc_id").collect()}
    assert got == {1: (2, 1, 1, 1, 3), 2: (0, 0, 0, 0, 0)}
