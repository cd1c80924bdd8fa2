"""Small documents with the awkward cases every operator must take."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int, words: str = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho") -> str:
    rng = random.Random(seed)
    pool = words.split()
    return " ".join(f"{rng.choice(pool)}{rng.randrange(40)}" for _ in range(n))


def rows():
    """Exact and near copies, nulls, empty and very long texts, repeated rows, shared passages."""
    passage = "\n".join(prose(900 + k, 30) for k in range(3))
    base = prose(1, 300)
    near = base.replace(base.split()[150], "changed", 1)
    out = [(k, prose(100 + k, 40 + 7 * k), "en", f"src{k % 3}") for k in range(12)]
    out += [(20, base, "en", "src0"), (21, base, "en", "src1"), (22, near, "de", None), (23, base, "en", "src0")]
    out += [(30 + k, f"{prose(200 + k, 20)}\n{passage}\n{prose(300 + k, 20)}", "fr", "src1") for k in range(3)]
    out += [(40, None, "en", "src0"), (41, "", None, "src0"), (42, " \n\t ", "en", "src0"), (43, "one", "en", "src2"), (44, "one two", None, None)]
    out += [(50, prose(5, 30000), "es", "src0"), (None, "no id here at all", "en", "src0"), (60, "twice", "en", "src0"), (60, "twice", "en", "src0")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in out]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
