import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, rid bigint, id string, size int, words string, row int, score double, h bigint, n int, key string, text_hash bigint"
#: Values of the columns that no operator asked for.
EXTRA = ("en", None, 1, "x", 2, "x", 3, "x", 4, 0.5, 5, 6, "x", 7)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empty and long texts, copies, near copies, repeated passages, repeated rows, ties."""
    r = random.Random(7)
    word = lambda: "".join(r.choice(["an", "re", "ti", "oß", "el", "qu", "st", "é"]) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(150)
    out = [prose(r.randint(1, 200)) for _ in range(40)]
    out += [None, "", "", " ", "one", "a b c d", "a b c d", prose(6000), "ab " * 3000, "x" * 2000, "\n\t\r \x0b\x0c", "\x00\x1f\x7f weird \U0001f600 text"]
    out += [out[3]] * 3 + [out[4].replace(" ", "\n "), out[5].replace(" ", "  ")]
    base = prose(240)
    for k in range(12):
        words = base.split()
        words[15 * k] = f"changed{k}"
        out.append(" ".join(words))
    out += [prose(60) + " " + passage + "\n" + prose(50) for _ in range(4)]
    rows = list(enumerate(out, 100))
    return rows + [rows[3], rows[3], (None, "null id text here now and then"), (None, out[3]), (7, out[8])]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, EXTRA[0], f"src{k % 5}" if k % 7 else None, *EXTRA[2:]) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def saved(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
