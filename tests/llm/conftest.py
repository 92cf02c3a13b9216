import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named as the operators name theirs.
EXTRA = "shard int, slot long, size long, copies int, piece long, bucket long, place int, fp long, root long, row_hash long, pos int, score double, copy int, tags map<string,int>"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", ".", ","]) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        out.append("\n".join(lines).capitalize())
    return out


def rows() -> list[tuple]:
    """Ordinary, equal, empty, null and very long texts; null and repeated ids; repeated rows; odd white space and characters."""
    body = texts(40)
    out = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t)) for i, t in enumerate(body)]
    out += [(100, body[3], "en", "s0", 1), (101, body[3], "fr", "s1", 1), (102, "", None, "s1", 0), (103, None, None, None, None), (104, "   \n\t ", "en", "s2", 5)]
    out += [(None, "a null id has a text of its own", "en", "s2", None), (None, None, None, None, None)]
    out += [(105, body[7], "en", "s3", 9)] * 2 + [(106, "one id, two texts of it", "en", "s3", 1), (106, "another text of the id", "en", "s3", 1)]
    out += [(107, " ".join(texts(3000, 2)), "en", "s0", 1), (108, "x" * 70_000, "en", "s2", 1), (109, "été über 😀 <|endoftext|> \x1c \x85 \xa0 naïve\x0bword\x0cend\r\n" + body[5], "de", "s\u00e9", 1)]
    out += [(110, body[9].upper(), "en", "S0", 2), (111, body[9] + " tail", "en", "s0", 3), ((1 << 60) + 1, "a very large id", "en", "s2", 3)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """The same rows with columns that clash."""
    from pyspark.sql import functions as F

    names = [x.rsplit(" ", 1) for x in EXTRA.split(", ")]
    return docs.select("*", *[F.create_map(F.lit("a"), F.lit(1)).alias(n) if n == "tags" else F.lit(None).cast(t).alias(n) for n, t in names])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(1, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def key(row) -> tuple:
    """Sorts rows with nulls."""
    return tuple((x is None, x if x is not None else 0) for x in row)
