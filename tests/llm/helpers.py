import re

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Rows (doc_id, text) with columns whose names clash with the operators' own."""
    full = [(i, t, "en", "s", 1, "x", 2.0) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, id long, key string, score double")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


ODD = [(1, None), (2, ""), (3, " "), (4, "One two"), (4, "One two"), (None, "null id"), (5, "a\tb\x0bc  d\n\n  é  行为 　 x"), (6, "w" * 5000), (7, "q r s t " * 3000), (8, "it's I'll 1234 !!?? <|endoftext|> \x00 end ")]
