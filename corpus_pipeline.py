"""Training-text pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heatframe.llm.decontamination import drop_contaminated
from heatframe.llm.files import step_table
from heatframe.llm.host_rules import keep_good
from heatframe.llm.packing import pack_documents
from heatframe.llm.partenum import keep_one_per_component
from heatframe.llm.registry import TOKENIZER, scratch, table
from heatframe.llm.secrets import redact

# No SQL: near-duplicate components, the forest and the packing have no form in it.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose source does not fail as a whole.

    A null text has no words and goes; a null source has no verdict; repeated rows are judged one by one and all count
    for their source. No documents give none.
    """
    return keep_good(docs, "source", folder=scratch(spark, "stage-quality"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked at a similarity of 0.8 over five-word shingles.

    Of repeated rows one stays; a row without an id stays if no other row with its set does. Texts without words link
    with nothing and stay.
    """
    return keep_one_per_component(docs, scratch(spark, "stage-jaccard"), num=80, den=100, width=5, parts=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item. Null texts have none and stay, ids play no part."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; documents are known by their texts, so null and repeated ids are
    cleaned alike. Null texts stay."""
    return redact(docs, scratch(spark, "stage-secrets"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces placed in sequences of at most 1024 tokens. A null text is one piece of its end token;
    repeated rows are packed one by one."""
    return pack_documents(docs, scratch(spark, "stage-packing"), TOKENIZER, 1024, end_id=2)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the output of each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = step_table(out, f"{folder}/{k}")
    return docs
