"""The training corpus from raw documents: five stages, each written as Parquet and read again.

1. quality: lines that too many documents of a host share are removed; documents that fail the
   base rules or are depleted by this go.
2. near duplicates: one document of each group of near copies (0.8 on shingles of five words) stays.
3. personal data: spans are replaced by their kind in angle brackets.
4. mixing: documents are repeated or left out to meet their sources' targets, in training order.
5. tokens: texts are encoded; the result has the columns of documents and ``token_ids``.

Rows with nulls, empty or very long texts, repeated rows and empty tables pass as the stages'
operators define it. Columns other than those of ``documents`` are not carried on.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from footfall.llm import bpe, mixing, near_dup, pii, quality
from footfall.llm.common import documents
from footfall.llm.queries import vocabulary
from footfall.session import materialize, release_scratch, scratch_tables

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHINGLE_WORDS = 5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_scratch: dict[int, list[str]] = {}  # by stage: tables that its result, while unwritten, reads


def stage(place: int) -> Callable[[Stage], Stage]:
    """A stage's input has been written, so what the stages before it kept aside is no longer read: it is deleted first."""

    def wrap(run: Stage) -> Stage:
        @functools.wraps(run)
        def stage_run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for earlier in [k for k in _scratch if k < place]:
                release_scratch(spark, _scratch.pop(earlier))
            known = set(scratch_tables())
            out = run(spark, docs, sf_dir)
            _scratch.setdefault(place, []).extend(p for p in scratch_tables() if p not in known)
            return out

        return stage_run

    return wrap


@stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs.select(*COLUMNS))


@stage(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_near_duplicates(docs, words=SHINGLE_WORDS)


@stage(2)
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


@stage(3)
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


@stage(4)
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixing", mix), ("tokens", tokens),
]

# Token ids and the trained span classifier are not SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = materialize(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
