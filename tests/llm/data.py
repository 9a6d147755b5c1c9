"""Rows that no operator may stumble over."""

import random

random.seed(5)
SYLLABLES = "an be co di el fa go hu in ja ko lu ma ne".split()


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]


BASE = words(120, 1)
NEAR = BASE[:60] + ["changed"] + BASE[61:]
FAR = BASE[:30] + words(90, 2)
LONG = words(30_000, 3)
PASSAGE = words(50, 4)
LINE = " ".join(words(20, 6))

ROWS = [
    (1, " ".join(BASE)),
    (2, " ".join(NEAR)),
    (3, " ".join(FAR)),
    (4, None),
    (5, ""),
    (6, " \n\t \r\n"),
    (7, " ".join(LONG)),
    (8, " ".join(LONG[:20_000]) + " tail"),
    (9, " ".join(words(40, 7) + PASSAGE + words(40, 8))),
    (10, " ".join(words(10, 9) + PASSAGE + PASSAGE)),
    (11, f"first own line here\n{LINE}\nlast line of it\n\n{LINE}"),
    (12, f"{LINE} extra\nfirst own line here\nßtrange ünïcode – “quotes” ΑΣ 日本語 😀"),
    (13, "one"),
    (14, "one two"),
    (15, "One TWO"),
    (16, "mail a.b+c@x-y.example.org or x@y or ip 10.0.0.256 and 10.20.30.40.50 card 4111 1111-1111 1111 tel +49 (30) 1234-5678 +1 2"),
    (17, "x" * 70_000),
    (18, "1" * 5_000 + " " + "a@" * 300 + " " + "." * 500),
    (19, "word " * 300),
    (20, "same line again\n" * 40),
    (None, " ".join(BASE)),
    (None, None),
    (1, " ".join(BASE)),
    (21, " ".join(PASSAGE)),
    (22, "<|endoftext|> it's <|startoftext|>x I'LL 123½ <|endo a\x1cb\x00c\x7f"),
]
BENCHMARK = [(1, " ".join(PASSAGE)), (2, "one two"), (2, " ".join(BASE[40:60])), (None, " ".join(FAR[50:70])), (3, None), (4, ""), (5, "...")]

# Further columns under names that operators use inside, in other types.
EXTRA = "text_ string, hash int, n_words string, row boolean, class int, key string, items int, `odd.name` string, `__q` int"


def frame(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        df = df.selectExpr("doc_id", "text", *[f"CAST(NULL AS {c.rsplit(' ', 1)[1]}) AS {c.rsplit(' ', 1)[0]}" for c in EXTRA.split(", ")])
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
