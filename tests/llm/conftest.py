import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, kind string, `class` string, h string, part string, batch string, gone int, removed int, key int"
EXTRA = ("x", 1, "y", "z", "w", "v", "u", 5, 6, 7)

LONG = " ".join(f"word{i} the of" for i in range(40_000))

#: Nulls in any column, empty, blank and very long texts, repeated ids and rows, no letters, odd characters.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it.\nA second line of the text stands here.", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, "b"),
    (4, "   \n\t \n", "fr", None),
    (5, "123 456 ... !!!", None, None),
    (6, LONG, "en", "c"),
    (7, "Le petit chat est sur la table et la porte de la maison est ouverte.", "fr", "c"),
    (7, "Le petit chat est sur la table et la porte de la maison est ouverte.", "fr", "c"),
    (7, "another text with the same id", "en", "d"),
    (None, "a text without an id", "en", "d"),
    (None, None, None, None),
    (8, "The quick brown fox jumps over the lazy dog and runs away from it.\nA second line of the text stands here.", "en", "e"),
    (9, "x" * 70_000, "en", "e"),
    (10, "日本語 текст ñandú   \x1c <|endoftext|> é", None, "f"),
]


def frame(spark, rows, sf=None):
    got = [(i, t, lang, source, None if t is None else len(t), *EXTRA) for i, t, lang, source in rows]
    df = spark.createDataFrame(got, SCHEMA)
    return df.repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, ROWS[:1]).where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def place(spark, tmp_path_factory):
    """Folders with tables of given rows, as queries read them."""

    def put(docs, labels=None, benchmark=None):
        at = tmp_path_factory.mktemp("tables")
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels or [], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(benchmark or [], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        return str(at)

    return put
