"""Plain Python versions of the rules that the corpus operators follow."""

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Clashing names that an input may carry besides its own columns.
EXTRA = ("key", "score", "label", "n_words", "text_key", "bucket", "cell", "__n", "__id", "part")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def union_find(pairs, ids):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def docs(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], DOCS)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in EXTRA})
    return df


#: Nulls, empty and blank texts, a repeated row, ties, one very long text.
ODD = [
    (1, None), (2, ""), (3, "   \n \t"), (4, "one two three"), (4, "one two three"), (5, "a b c d e f g h i j k l m n o p"),
    (6, "é ü ñ Straße ÀÉ 你好 世界"), (7, "x " * 60000), (8, "..., !!! ???"), (9, "a  b\x1c c \n d e "),
]
