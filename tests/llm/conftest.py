import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF = "/root/testdata/sf0.001"

# Texts that every operator must take: NULL, empty, blank, one word, one very long word, symbols only.
ODD_TEXTS = [None, "", "  \n\t ", "word", "a" * 50_000, "!!! ... ???", "多语言 текст ñandú", "▁ ▁", "x\x00y", "ends\n"]


def docs_of(spark, texts, start=0, extra=False):
    """A documents table of texts; ``extra`` adds columns whose names operators use inside."""
    rows = [(start + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("_key", "_row", "size", "score", "cid", "k", "shard", "leaks", "bucket", "_id", "id"):
            df = df.selectExpr("*", f"doc_id AS `{c}`")
    return df


@pytest.fixture(scope="session")
def sf():
    return SF
