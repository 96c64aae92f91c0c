from __future__ import annotations

import public_tokenizers
import pytest


@pytest.fixture(scope="session")
def bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture()
def docs(spark):
    """(doc_id, text, lang, source) rows to documents."""

    def make(rows):
        rows = [(*r, *(None,) * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
