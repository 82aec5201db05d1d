"""Small documents with nulls, empty and blank texts, ties, copies, long texts and clashing columns."""

import random


def documents(spark, seed=1, n=120, extra=True):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéßz") for _ in range(r.randint(1, 7))) for _ in range(60)]
    base = [[r.choice(words) for _ in range(r.randint(30, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 9])):
            text[r.randrange(len(text))] = f"w{r.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "a"), (1004, "a"), (1005, "x " * 4000), (1006, "z" * 9000), (3, rows[3][1]), (1007, "Tie. tie? TIE!")]
    if not extra:
        return rows, spark.createDataFrame(rows, "doc_id bigint, text string")
    rows2 = [(i, t, i, "row", 5, None) for i, t in rows]
    return rows, spark.createDataFrame(rows2, "doc_id bigint, text string, rid bigint, row string, n bigint, packed string")


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
