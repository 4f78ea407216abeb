"""Small inputs with every awkward row, and brute-force readings of the contracts."""

import random

DOCUMENTS = "doc_id long, text string, _k1 string, kind int, node string, hash long, n double"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiouéü") for _ in range(draw.randint(1, 3)))
             for _ in range(vocabulary)]
    return "".join(draw.choice(words) + draw.choice([" ", " ", " ", ", ", ".\n"]) for _ in range(n))


def awkward() -> list[tuple[int | None, str | None]]:
    """Null ids and texts, empty and blank texts, repeated rows, copies, near copies, long and periodic texts."""
    base = prose(1, 300)
    near = base.split(" ")
    near[40] = "altered"
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (None, "no id at all"),
        (7, prose(2, 500)), (7, prose(2, 500)), (8, prose(3, 4000)), (9, "one"), (10, "two words"),
        (11, "ab " * 3000), (12, "x" * 5000), (13, prose(4, 80) + base[:900] + prose(5, 80)),
        (14, prose(6, 60) + base[450:1000] + prose(7, 60)), (15, "Ünïcode 😀 text 😀 " + prose(8, 30)), (16, prose(9, 200)),
    ]


def documents(spark, rows=None):
    """Documents with further columns whose names the operators use themselves."""
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(i, t, "a", 1, "b", 2, 0.5) for i, t in rows], DOCUMENTS)


def clean_rows(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=repr)
