import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["th", "er", "on", "an", "re", "ti", "es"]) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return "".join(w + ("\n" if k % 17 == 16 else " ") for k, w in enumerate(words)).strip()


@pytest.fixture(scope="session")
def small(spark):
    """Texts with copies, near copies, shared lines, junk, a very long text, nulls, repeated rows and clashing columns."""
    base = [prose(k, 60 + 7 * k) for k in range(12)]
    line = "This line is shared by many of the documents here."
    rows = [(k, t + "\n" + line, ["en", "de"][k % 2], f"src{k % 3}") for k, t in enumerate(base)]
    rows += [(20, base[3], "en", "src0"), (21, base[3], "de", "src1"), (22, base[3].replace(base[3].split()[50], "changed", 1), "en", "src2")]
    rows += [(30, "&&& ".join(base[4].split()), "en", "src0"), (31, "same " * 300, "en", "src0"), (32, "one two three", "fr", "src2"), (33, "", "en", "src1"), (34, None, "en", "src1")]
    rows += [(35, prose(99, 30000), "en", "src0"), (36, base[5], None, None), (None, base[6], "en", "src1"), (7, base[7] + "\n" + line, "de", "src1"), (37, "é ß Σ 1½ 漢字<|endoftext|>İ\n\n \n", "en", "src1")]
    rows = [(*r, len(r[1] or "")) for r in rows]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(small):
    """small with columns of names that operators use."""
    names = "quality kept base_failed n_lines n_dropped n_tokens epoch class_id content ids decoded score licenses __hash __of __id __leaf stats".split()
    return small.selectExpr("*", *(f"'kept as it is' AS {n}" for n in names))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
