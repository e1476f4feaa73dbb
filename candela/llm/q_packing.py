"""Query of packing; its ids come from a tokenizer file, so it has no SQL and is tested by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from candela.llm import packing
from candela.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLES: dict[str, str] = {}
