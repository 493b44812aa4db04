import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    def make(texts, schema=SCHEMA):
        """texts: strings, or (doc_id, text), or whole rows."""
        rows = []
        for i, t in enumerate(texts):
            if not isinstance(t, tuple):
                t = (i, t)
            if len(t) == 2:
                t = (*t, "en", f"src{(t[0] or 0) % 3}", len(t[1] or ""))
            rows.append(t)
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def hard(documents):
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    long = " ".join(f"word{i * 7919 % 5000}" for i in range(30000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "de", "b", len(long)), (5, long + " tail", "de", "b", len(long) + 5), (6, "x" * 200_000, "en", None, 200_000),
        (7, "one two three", "en", "a", 13), (7, "one two three", "en", "a", 13), (8, "ONE two  three", "en", "", 14), (9, "日本語 テキスト é \u0000 ok", "ja", "c", 20), (None, "orphan text of no id", "en", "a", 20), (-5, "a negative id stands here too", "en", "a", 28),
    ]
    return documents(rows)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables to a folder like the driver's; gives the folder."""

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


@pytest.fixture
def scratch(spark):
    from lorewell.llm.shared import Scratch

    return Scratch(spark, "test")
