"""Small awkward tables: NULLs, empty and blank texts, long ones, ties, repeated rows, columns with clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{i % 701} other{i % 13}" for i in range(12_000))
TEXTS = [
    (1, "Released under the MIT License. token = \"0123456789abcdef0123456789abcdef01234567\" end"),
    (2, None), (3, ""), (4, "  \n\t "), (5, LONG), (6, LONG), (None, "no id at all, but words enough to count"),
    (7, "same text here"), (7, "same text here"), (8, "same text here"), (9, "ÀÉ ▁mark ▁▁ 漢字🙂 \x00 end"),
    (10, "you are an idiot and a moron"), (11, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
]
CLASHING = ("text", "ids", "n_tokens", "simhash", "toxicity", "n_words", "spans", "items", "notices", "fingerprint",
            "part", "key", "place", "row_key", "host", "path", "rule", "verdict")


def documents(spark, rows=None, extra=True):
    df = spark.createDataFrame(TEXTS if rows is None else rows, "doc_id long, text string")
    if extra:
        df = df.selectExpr("*", *[f"'old' AS {c}" for c in CLASHING if c != "text"])
    return df
