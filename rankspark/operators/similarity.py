"""TF-IDF weights and text similarity between the query and the item of one row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import text
from rankspark.functions.features import let
from rankspark.operators.skew import attach, split_repeated
from rankspark.session import materialise

# BM25 parameters.
K1 = 1.2
B = 0.75

Terms = Callable[[Column], Column]


def unigrams(c: Column) -> Column:
    return F.split(c, " ")


def bigrams(c: Column) -> Column:
    return text.word_bigrams(F.split(c, " "))


#: Rows of an Arrow batch whose terms are counted together.
COUNTED_ROWS = 512


def _row_counts(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf) of each row for itself, without an exchange."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_ROWS):
                keys, lists = batch.slice(start, COUNTED_ROWS).columns
                found = pc.list_flatten(lists).dictionary_encode()
                if not len(found):
                    continue
                codes = pc.list_parent_indices(lists).to_numpy() * len(found.dictionary) + found.indices.to_numpy()
                codes, tf = np.unique(codes, return_counts=True)
                row, term = np.divmod(codes, len(found.dictionary))
                yield pa.record_batch([keys.take(pa.array(row)), found.dictionary.take(pa.array(term)), pa.array(tf, pa.int64())], [key, "term", "tf"])

    rows = docs.select(key, F.filter(terms, lambda t: t.isNotNull()).alias("terms"))
    return rows.mapInArrow(count, f"{key} {dict(rows.dtypes)[key]}, term string, tf bigint")


def term_frequencies(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf) for every document. A document on one row is counted there; only the counts
    of those on several rows are exchanged. Pass stored rows: they are read more than once."""
    single, several = split_repeated(docs, key)
    counts = _row_counts(single, key, terms)
    if several is not None:
        counts = counts.unionByName(_row_counts(several, key, terms).groupBy(key, "term").agg(F.sum("tf").alias("tf")))
    return counts


def tfidf(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """(key, term, tf, weight) over a corpus of documents; idf = ln((N + 1) / (df + 1)) + 1."""
    tf = materialise(term_frequencies(docs, key, terms), "term-counts")
    n_docs = docs.count()
    # Most terms are those of a single document; only the others' counts are joined.
    shared = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    idf = F.log((F.lit(n_docs) + 1) / (F.coalesce("df", F.lit(1)) + 1)) + 1
    return attach(tf, shared, ["term"], "left").select(key, "term", "tf", (F.col("tf") * idf).alias("weight"))


def text_vectors(corpus: DataFrame, **kinds: Terms) -> DataFrame:
    """One row per distinct text of a corpus column ``text``, with a map
    term -> (tf, idf) for every kind of term (output name -> terms of a text).

    Weights are computed once per distinct text, however many documents carry it.
    """
    docs = materialise(corpus.groupBy("text").agg(F.count(F.lit(1)).alias("n")), "texts")
    n_docs = docs.agg(F.sum("n")).first()[0] or 0
    tagged = lambda name, terms: F.transform(
        terms(F.col("text")), lambda t: F.struct(F.lit(name).alias("kind"), t.alias("term"))
    )
    tf = (
        docs.select("text", "n", F.inline(F.concat(*[tagged(k, f) for k, f in kinds.items()])))
        .groupBy("text", "n", "kind", "term")
        .agg(F.count(F.lit(1)).cast("double").alias("tf"))
    )
    idf = tf.groupBy("kind", "term").agg((F.log((F.lit(n_docs) + 1) / (F.sum("n") + 1)) + 1).alias("idf"))
    entry = F.struct("term", F.struct("tf", "idf"))
    of_kind = lambda name: F.map_from_entries(
        F.array_compact(F.collect_list(F.when(F.col("kind") == name, entry)))
    ).alias(name)
    return attach(tf, idf, ["kind", "term"]).groupBy("text").agg(*[of_kind(k) for k in kinds])


def attach_vectors(rows: DataFrame, column: str, vectors: DataFrame) -> DataFrame:
    """Add the vectors of the text in ``column``; a text without terms gets empty maps."""
    names = [c for c in vectors.columns if c != "text"]
    empty = F.map_from_entries(F.array().cast(
        "array<struct<term:string,v:struct<tf:double,idf:double>>>"
    ))
    joined = attach(rows, vectors.withColumnRenamed("text", column), [column], "left")
    return joined.withColumns({c: F.coalesce(c, empty) for c in names})


def per_texts(rows: DataFrame, columns: Sequence[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows with the columns that ``score`` adds to the distinct combinations of their text columns,
    however many rows hold one. Pass written rows, so that they aren't evaluated twice."""
    texts = materialise(rows.select(*columns).distinct(), "text-pairs")
    return attach(rows, score(texts), columns)


COSINE = "cosine match_weight match_count_ratio match_weight_ratio query_max_weight item_max_weight".split()


def _sum(values: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + f(v))


def _max(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def _matched(q: Column, d: Column, pair: Callable[[Column, Column], Column]) -> Column:
    """``pair`` of both entries of every term that both maps hold, met in time linear in their sizes."""
    met = F.map_zip_with(q, d, lambda t, a, b: F.when(a.isNotNull() & b.isNotNull(), pair(a, b)))
    return F.array_compact(F.map_values(met))


def cosine_features(q: Column, d: Column) -> Column:
    """Array of the COSINE features: cosine, matched query weight, matched share by count and by
    weight, and the largest matched weight on each side. The terms are met once for all of them."""
    w = lambda v: v.tf * v.idf
    square = lambda m: _sum(F.map_values(m), lambda v: w(v) * w(v))

    def six(met: Column) -> Column:
        matched, total = _sum(met, lambda p: p.a), _sum(F.map_values(q), w)
        length = F.sqrt(square(q) * square(d))
        return F.array(
            F.when(length > 0, _sum(met, lambda p: p.a * p.b) / length).otherwise(0.0), matched,
            F.when(F.size(q) > 0, F.size(met) / F.size(q)).otherwise(0.0), F.when(total > 0, matched / total).otherwise(0.0),
            _max(F.transform(met, lambda p: p.a)), _max(F.transform(met, lambda p: p.b)))

    return let(_matched(q, d, lambda a, b: F.struct(w(a).alias("a"), w(b).alias("b"))), six)


def bm25(q: Column, d: Column, mean_length: float) -> Column:
    """BM25 of the query terms against one item text of the row."""
    def total(length: Column) -> Column:
        part = lambda _, e: e.idf * e.tf * (K1 + 1) / (e.tf + K1 * (1 - B + B * length / mean_length))
        return _sum(_matched(q, d, part), lambda x: x)

    return let(_sum(F.map_values(d), lambda v: v.tf), total)


def mean_length(corpus: DataFrame, terms: Terms) -> float:
    """Average number of terms per document of a corpus column ``text``."""
    return corpus.agg(F.avg(F.size(terms(F.col("text"))))).first()[0] or 1.0


def similarity_features(
    rows: DataFrame, queries: DataFrame, names: DataFrame, addrs: DataFrame
) -> DataFrame:
    """The 23 similarity features of rows with ``query``, ``name`` and ``addr``, as one
    array column ``sim``; the other three inputs are corpora with a ``text`` column.
    They are computed once per distinct combination of the three texts; pass written rows."""
    return per_texts(rows, ["query", "name", "addr"], lambda texts: _similarities(texts, queries, names, addrs))


def _similarities(rows: DataFrame, queries: DataFrame, names: DataFrame, addrs: DataFrame) -> DataFrame:
    r = attach_vectors(rows, "query", text_vectors(queries, q1=unigrams, q2=bigrams))
    r = attach_vectors(r, "name", text_vectors(names, n1=unigrams, n2=bigrams))
    r = attach_vectors(r, "addr", text_vectors(addrs, a1=unigrams))
    one = cosine_features(F.col("q1"), F.col("n1"))
    two = cosine_features(F.col("q2"), F.col("n2"))
    name_bm25 = bm25(F.col("q1"), F.col("n1"), mean_length(names, unigrams))
    addr_bm25 = bm25(F.col("q1"), F.col("a1"), mean_length(addrs, unigrams))
    count = lambda c: F.size(F.split(c, " ")).cast("double")
    size = lambda c: F.length(c).cast("double")
    sim = F.concat(F.array(F.lit(1.0)), one, two, F.array(
        name_bm25, addr_bm25,
        text.edit_similarity(F.col("query"), F.col("name")),
        text.edit_similarity(F.col("query"), F.col("addr")),
        count("query"), count("name"), count("addr"), size("query"), size("name"), size("addr"),
    ))
    return r.withColumn("sim", sim).drop("q1", "q2", "n1", "n2", "a1")
