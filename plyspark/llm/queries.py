"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import CONTAINED_SQL, contained_items
from .html_text import extract_text
from .jaccard import COMPONENTS_SQL, jaccard_components
from .mixing import MIX_SQL, mix
from .neighbours import NEAREST_SQL, nearest
from .pii import replace_entities
from .quality import fit, score
from .substrings import REPEATS_SQL, remove_repeats
from .token_counts import token_counts
from .token_records import token_records

#: The folder of public vocabulary files; a parameter, as the files are not part of this repository.
TOKENIZERS = os.environ.get("PLYSPARK_TOKENIZERS", "")
#: The operator asks for a key; only this query names one, for tests.  Whoever holds a key can link surrogates to guesses.
TEST_KEY = os.environ.get("PLYSPARK_PII_KEY", "a key for tests")


def tokenizer(name: str) -> str:
    if TOKENIZERS:
        return f"{TOKENIZERS}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), limit=2048, with_table=True)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key=TEST_KEY)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "position")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_token_records": op2_token_records,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_token_counts": op5_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_html_text": op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": CONTAINED_SQL,
    "op3_nearest_neighbours": NEAREST_SQL,
    "op6_substring_dedup": REPEATS_SQL,
    "op7_mixing": MIX_SQL,
    "op9_jaccard_join": COMPONENTS_SQL,
}
