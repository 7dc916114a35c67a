"""The stages of the corpus pipeline: each takes documents and returns documents, by one operator.

Columns of whatever name come back as they were: a stage works on names of its own.  Rows of
null id or text, repeated rows, very long texts and empty tables pass through as each
stage's docstring says; none of them is dropped for being odd.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeflow.llm import language, mixing, packing, simhash, suffix
from edgeflow.llm.queries import vocabulary

#: Posterior below which a language is not taken as known.
SURE = 0.5
#: Bytes of a string that is searched for, and the words that a repeated passage has at least.
PASSAGE, PASSAGE_WORDS = 200, 50


class Apart:
    """``docs`` under names that no operator uses, and the way back."""

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.own = [f"column_{i}" for i in range(len(docs.columns))]
        self.docs = docs.toDF(*self.own)

    def __getitem__(self, name: str) -> str:
        return self.own[self.columns.index(name)]

    def back(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.own).toDF(*self.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the corpus knows; all of them if none is labelled.

    A null, empty or letterless text has no language and goes, however many rows have it.
    A null id changes nothing; of equally likely languages the first by name is taken; a
    very long text is scored whole.  An empty table stays empty.
    """
    d = Apart(docs)
    model = language.fit(d.docs, vocabulary("piece_bpe_32k.model"), d["doc_id"], d["text"], d["lang"])
    if not model.names:
        return docs
    named = model.predict(d.docs, d["text"], d.own)
    return d.back(named.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of smallest id (null last), then of smallest text digest.

    Null, empty and blank texts are copies of each other; of equal rows one stays; a very
    long text is compared whole.  An empty table stays empty.
    """
    d = Apart(docs)
    return d.back(simhash.one_of_each(d.docs, d["doc_id"], d["text"]))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated passages; those with nothing left go.

    A passage repeats strings of ``PASSAGE`` bytes over ``PASSAGE_WORDS`` words or more.
    Earlier is by id (null last), text digest and place; a passage also repeats within one
    text, however long.  Null and short texts pass as they are.  Rows equal in id and text
    are one document here and keep the same.  ``n_chars`` is counted again where a text
    changed.  An empty table stays empty.
    """
    d = Apart(docs)
    text = d["text"]
    cut = suffix.remove_repeats(d.docs, d["doc_id"], text, PASSAGE, "first", d.own, characters=True, least_words=PASSAGE_WORDS)
    touched = F.size("spans") > 0
    out = cut.where(~touched | (F.length("kept") > 0))
    out = out.withColumn(text, F.when(touched, F.col("kept").cast("string")).otherwise(F.col(text)))
    if "n_chars" in d.columns:
        size = F.length(text).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(d["n_chars"], F.when(touched, size).otherwise(F.col(d["n_chars"])))
    return d.back(out)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought to their target shares, globally shuffled.

    A null source is a source; rows of equal or null id share their number of copies; texts,
    null, empty or very long, pass unchanged.  An empty table stays empty.
    """
    d = Apart(docs)
    return d.back(mixing.mix(d.docs, d["doc_id"], d["source"]))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: a row for each piece of a document, as ``packing.pack`` returns them.

    A null or empty text is its end id alone; a very long text is many pieces; repeated rows
    and null ids are documents of their own.  An empty table gives no pieces.  Columns other
    than id and text are left out.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))
