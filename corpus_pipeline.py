"""The corpus pipeline: bad documents, common lines, near duplicates and repeated passages go, the rest is packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.llm import bwt_dedup, jaccard_join, line_crf, line_dedup, packing
from corvella.session import materialize, read_table


def _shielded(docs: DataFrame, added: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` with the text that ``operator`` leaves and ``n_chars``, where there is one, of that text.

    The operator adds columns of its own; columns of ``docs`` of those names wait under others and come back unchanged.
    """
    taken = {c: f"__own_{i}" for i, c in enumerate(docs.columns) if c.lower() in added}
    found = operator(docs.withColumnsRenamed(taken))
    back = {c: F.col(taken.get(c, c)).alias(c) for c in docs.columns}
    if "n_chars" in back:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.select(*back.values())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the line CRF scores at its threshold or above.

    Null, empty and very long texts are scored like any other, repeated rows each; the threshold itself stays. Rows with a
    null id are scored too. No column is added or changed, whatever its name; an empty table gives no rows. Without
    labels every score is 0.5 and nothing stays.
    """
    model = line_crf.train(docs, read_table(spark, sf_dir, "labels"))
    kept = line_crf.score(docs, model, score_col="__score").where(F.col("__score") >= line_crf.THRESHOLD)
    return kept.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines of three documents or more but in the last of them; every document stays.

    A null text becomes an empty one. Rows of one id are one document when documents are counted, and repeated rows lose the
    same lines; rows with a null id lose none. Time grows with the lines of a text, however long. Columns
    named like the operator's own (``n_lines``, ``n_dropped``) keep their values; an empty table gives no rows.
    """
    return _shielded(docs, ("n_lines", "n_dropped"), line_dedup.dedup_lines)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of the least id stays; rows with a null id all stay.

    Null and empty texts are copies of each other. Rows of one id stay or go together, by the text of the first set key;
    a class's ties are broken by the id. No column is added or changed, whatever its name; an empty table gives no rows.
    """
    others = jaccard_join.jaccard_join(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut 50-byte passages of documents of smaller id; every document stays.

    Null texts become empty; characters that a cut breaks go. Rows of one id do not count against each other, and rows with a
    null id lose nothing. Columns named like the operator's own (``n_bytes``, ``n_removed``, ``n_spans``, ``kept_bytes``) keep
    their values; an empty table gives no rows. A very long text is a piece of its own.
    """
    return _shielded(docs, ("n_bytes", "n_removed", "n_spans", "kept_bytes"), lambda d: bwt_dedup.drop_repeats(d, as_text=True))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, each a sequence.

    A null or empty text is its end id alone; repeated rows and rows with a null id are packed each. Very long texts are cut
    like others. Of the columns only the id and the text are read; an empty table gives no rows.
    """
    cut = packing.pack_power_of_two(docs, packing.default_tokenizer())
    return cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("passages", passages), ("packed", packed)]

#: Training, banding and tokenizing have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each but the last is written to the shared folder and read again.

    Nulls, empty and very long texts, repeated rows, empty tables and clashing names are each stage's own; none drops a row but
    the first and the third.
    """
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, f"stage-{name}")
    return docs
