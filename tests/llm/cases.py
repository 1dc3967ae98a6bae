"""Small tables for the tests: odd rows, repeated rows, and columns whose names clash with the operators' own."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "h long, fp long, id long, part long, spans string, score double, seeds string, words string, _first long, _turn long, _leak long"

ODD = [
    (None, "no id at all"), (900, None), (901, ""), (902, " \t\n "), (903, "  a  b \n\n c\t d　 e  "), (904, "don't it'S I'll 123 45!?́ ẛ\r\n\r\n x\x1c y"),
    (905, "one"), (906, "One"), (906, "One"), (907, "two words"), (908, "=====aaaaaaa===a=="), (909, "x" * 3000), (910, "<|endoftext|> <|startoftext|>x"), (911, "ÀÉ ÀÉ àé"),
]


def sentences(rng: random.Random, n: int) -> str:
    parts = ["re", "th", "ion", "er", "an", "st", "le", "ou", "é", "ñ"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") for w in words)


def documents(seed: int = 1, n: int = 40) -> list[tuple]:
    """(doc_id, text): fresh texts, exact and near copies, and passages that several share."""
    rng = random.Random(seed)
    rows: list[tuple] = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice(rows)[1]
        elif rows and kind < 0.35:
            words = rng.choice(rows)[1].split(" ")
            words[rng.randrange(len(words))] = "edit"
            text = " ".join(words)
        elif rows and kind < 0.5:
            words = rng.choice(rows)[1].split(" ")
            text = sentences(rng, 20) + " " + " ".join(words[: rng.randint(40, 120)]) + "\n" + sentences(rng, 10)
        else:
            text = sentences(rng, rng.randint(5, 300))
        rows.append((i, text))
    return rows


def frame(spark, rows, clashing: bool = False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    if clashing:
        for field in CLASHING.split(", "):
            name, kind = field.split(" ")
            df = df.selectExpr("*", f"cast(null as {'bigint' if kind == 'long' else kind}) as {name}")
    return df


def same(df, want) -> bool:
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    want = sorted(want, key=repr)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want):
        assert a == b
    return True
