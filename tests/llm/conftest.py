import pytest

from docquery.llm import common


@pytest.fixture(scope="session")
def docs_of(spark):
    """documents rows from (doc_id, text[, source[, lang]]), with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(*r, "src0", "en")[:4] if len(r) == 2 else (*r, "en")[:4] for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, source string, lang string")
        return df.selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as long) as n_chars", "1 as size", "'x' as u", "2 as fp", "3 as part", "4 as shard")

    return make


@pytest.fixture(scope="session")
def scratch(spark):
    return common.scratch_dir(spark)
