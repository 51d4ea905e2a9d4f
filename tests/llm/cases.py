"""Small tables with nulls, empty, long, equal and repeated texts."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    for _ in range(n):
        out.append(r.choice(WORDS) + str(r.randint(0, 400)))
        if r.random() < 0.1:
            out[-1] += ".\n"
    return " ".join(out)


def edge_rows() -> list[tuple]:
    """doc_id, text"""
    a = prose(1, 120)
    words = a.split(" ")
    near = " ".join([*words[:60], "changed", *words[61:]])
    return [
        (0, a),
        (1, near),
        (2, a),
        (3, None),
        (4, ""),
        (5, "  \n\t "),
        (6, "one two three"),
        (7, "one two three"),
        (8, prose(2, 9000)),
        (9, "Ünïcödé ΣΑΣ 日本語 🙂 'll don't <|endoftext|> x" * 3),
        (10, "a" * 3000),
        (11, prose(3, 40) + "\n" + "\n".join(a.split("\n")[2:8])),
        (12, prose(4, 80)),
        (12, prose(4, 80)),
        (None, prose(5, 70)),
    ]


SCHEMA = "doc_id long, text string, lang string, _id long, hits string, n long"


def edge_docs(spark):
    """The rows with extra columns whose names operators might use inside."""
    return spark.createDataFrame([(d, t, "en", 7, "x", 1) for d, t in edge_rows()], SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
