"""Text to vectors through a pluggable encoder; the default is hashed TF-IDF of unit length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import code_slices, split_codes
from corpusloom.operators.terms import with_terms
from corpusloom.sources.sinks import append_chunks

Encoder = Callable[[list[str]], list[list[float]]]


def encode_with(df: DataFrame, id_col: str, text: str, encoder: Encoder, batch: int = 256) -> DataFrame:
    """(id, embedding) by a model that takes lists of texts; null texts are encoded as empty ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            texts = p["text"].fillna("").tolist()
            vecs = [v for i in range(0, len(texts), batch) for v in encoder(texts[i : i + batch])]
            yield pd.DataFrame({"id": p["id"], "embedding": [[float(x) for x in v] for v in vecs]})

    x = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return x.mapInPandas(run, f"id {x.schema['id'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("id", id_col)


def encode_resumably(df: DataFrame, id_col: str, text: str, encoder: Encoder, path: str, chunks: int = 8, limit: int | None = None, tell: Callable[[dict], None] = lambda _: None) -> int:
    """Appends the embeddings of the rows that the table at ``path`` does not hold, chunk by chunk; a run that ends early
    goes on where it stopped. ``limit``: at most so many rows in this run. ``tell`` gets rows done, rate and time left."""
    return append_chunks(df.select(id_col, text), lambda x: encode_with(x, id_col, text, encoder), path, id_col, chunks, limit, tell)


def hashed_tfidf(df: DataFrame, id_col: str, text: str, dims: int = 256) -> DataFrame:
    """(id, embedding) of hashed words and word pairs, weighted by rarity over all rows, of unit length (a text
    without terms: the zero vector)."""
    x = with_terms(df.select(F.col(id_col), F.col(text).alias("_t")), "_t", "terms").drop("_t")
    tf = HashingTF(numFeatures=dims, inputCol="terms", outputCol="tf").transform(x)
    v = IDF(inputCol="tf", outputCol="v").fit(tf).transform(tf)
    return Normalizer(inputCol="v", outputCol="u").transform(v).select(id_col, vector_to_array("u").alias("embedding"))


def code_view(df: DataFrame, id_col: str, codes: str, length: int = 8) -> tuple[DataFrame, list[str]]:
    """(id, codes_view) with one 0/1 place per distinct code head in sorted order, of unit length, and the order.

    The driver holds the distinct heads, which the classification bounds; each record looks its own heads up in their
    index, and the matrix stays distributed."""
    x = df.select(F.col(id_col), code_slices(split_codes(F.col(codes)), length).alias("_c"))
    names = [r[0] for r in x.select(F.explode("_c").alias("c")).distinct().orderBy("c").collect()]
    if not names:
        return x.select(id_col, F.array().cast("array<double>").alias("codes_view")), names
    hot = CountVectorizerModel.from_vocabulary(names, inputCol="_c", outputCol="_h").setBinary(True).transform(x.withColumn("_c", F.coalesce("_c", F.array().cast("array<string>"))))
    return Normalizer(inputCol="_h", outputCol="_u").transform(hot).select(id_col, vector_to_array("_u").alias("codes_view")), names
