"""Documents with nulls, empty and long texts, ties, repeated rows and columns that operators might clash with."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", str(rng.randrange(30))]))
        if rng.random() < 0.05:
            out[-1] += "\n" + rng.choice(WORDS)
    return " ".join(out)


def rows():
    base = text(1, 120)
    near = base.replace("alpha", "ALPHA").split(" ")
    near[60] = "changed"
    out = [(i, text(i + 10, 5 + 7 * i), "en", f"s{i % 3}", 0) for i in range(20)]
    out += [(100, base, "en", "s0", 0), (101, base, "en", "s1", 0), (102, " ".join(near), None, None, None)]
    out += [(103, "", "en", "s0", 0), (104, None, None, "s1", None), (105, "  \n\t ", "de", None, 0), (106, "É ß ½ 𝒳 <|endoftext|>", "fr", "", 0)]
    out += [(107, text(5, 6000), "en", "s2", 0), (108, base, "en", "s2", 0), (108, base, "en", "s2", 0), (None, text(6, 30), "en", "s0", 0)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    clashing = ["words", "score", "part", "bucket", "length", "size", "fp", "u", "v", "block", "held_out", "copies", "rank", "at"]
    return df.select("*", *(F.lit("clash").alias(c) for c in clashing))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
