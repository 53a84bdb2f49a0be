"""Problem 3: token budget per source, language and domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runeworks.functions.labels import family_label, label, language
from runeworks.llm.bpe import TOKENIZERS, count_tokens, rank_file
from runeworks.operators.latest import latest


def text_key(text: Column) -> Column:
    """128-bit identity of a whole text; null and empty texts have none."""
    return F.when(text != "", F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(31), text))))


def token_budget(
    documents: DataFrame, records: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS
) -> DataFrame:
    """Usable text per slice: ``table_name, source, lang, official_family, records, texts, tokens``.

    ``documents`` counts ``text``; ``sft_records`` counts ``prompt`` and ``completion``
    together, each ``record_id`` once by its latest ``built_at``. Counts are exact under the
    tokenizer. ``texts`` is the number of texts that are not null or empty; those have no
    tokens but their rows count as records. Labels and language codes are canonical; where
    there is none the column is null. A row with a null id counts as a record of its own in
    ``documents`` and is left out of ``sft_records``, where it identifies nothing. Empty
    tables give no rows.

    Whole texts are hashed and deduplicated first, so each distinct text of both tables is
    tokenized once. The rows that carry labels move only their 128-bit keys, pre-aggregated to
    multiplicities per slice and key; exact counts are joined back to those.
    """
    labels = {
        "documents": (label(F.col("source")), language(F.col("lang")), family_label(F.col("official_family"))),
        "sft_records": (label(F.col("source_dataset")), language(F.col("lang")), family_label(F.col("official_family"))),
    }
    names = ("source", "lang", "official_family")
    docs = documents.select(*[c.alias(n) for c, n in zip(labels["documents"], names)], F.array(text_key(F.col("text"))).alias("__keys"))
    own = dict(zip(names, labels["sft_records"]))
    recs = latest(
        records, "record_id", "built_at", **own, __p=text_key(F.col("prompt")), __c=text_key(F.col("completion"))
    ).select(*names, F.array("__p", "__c").alias("__keys"))
    rows = docs.withColumn("table_name", F.lit("documents")).unionByName(recs.withColumn("table_name", F.lit("sft_records")))
    cells = ["table_name", *names]
    held = (
        rows.select(*cells, F.posexplode("__keys").alias("__i", "__k"))
        .groupBy(*cells, "__k")
        .agg(F.count(F.lit(1)).alias("__times"), F.sum((F.col("__i") == 0).cast("long")).alias("__records"))
    )
    texts = (
        documents.select(F.col("text").alias("__t"))
        .unionByName(records.select(F.explode(F.array("prompt", "completion")).alias("__t")))
        .where(F.col("__t") != "")
        .select(text_key(F.col("__t")).alias("__k"), "__t")
        .dropDuplicates(["__k"])
    )
    counted = count_tokens(texts, "__t", rank_file(tokenizer, folder))
    return (
        held.join(counted, "__k", "left")
        .groupBy(*cells)
        .agg(
            F.sum("__records").alias("records"),
            F.sum(F.when(F.col("__k").isNotNull(), F.col("__times")).otherwise(0)).alias("texts"),
            F.sum(F.coalesce(F.col("__times") * F.col("tokens"), F.lit(0))).alias("tokens"),
        )
    )
