import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


def prose(seed: int, words: int, stem: str = "w") -> str:
    return " ".join(f"{stem}{(seed * 7919 + i * i * 31 + i * 17) % 9973}" for i in range(words))


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts: (text or (id, text)), with ids from 0."""

    def run(texts, **extra):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        df = spark.createDataFrame([(i, t, None if t is None else "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
        for k, v in extra.items():
            df = df.withColumn(k, v)
        return df

    return run


#: Null, empty, white space, no letters, short, repeated, very long.
ODD = [None, "", " \n\t ", "***", "one", "a b c", "a b c", prose(1, 20_000), "\n".join(["same line of five words"] * 30), "x" * 50_000, "tab\tand\x0bvt é中文 \U0001f600 \x1c<|endoftext|> end"]
