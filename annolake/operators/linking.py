"""Entity linking: knowledge base, exact-match cascade, mention priors, BM25, nearest vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annolake.operators.dense import nearest, nearest_listed, nearest_of_few  # noqa: F401  linking's vector search
from annolake.operators.spans import first_wins

#: Spellings of "no concept".
NIL = ["", "-1", "NIL", "nil", "None", "none", "null"]


def normal(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def known_uris(entities: DataFrame, keys: list[str]) -> DataFrame:
    """keys, uris (sorted), uri (the first): of mentions that have one."""
    some = entities.filter(F.col("uri").isNotNull() & (F.col("uri") != "")).withColumn("text_norm", normal(F.col("text_span")))
    return some.groupBy(*keys).agg(F.array_sort(F.collect_set("uri")).alias("uris"), F.min("uri").alias("uri"))


def of_all_labels(by_label: DataFrame) -> DataFrame:
    """`known_uris` by text of those by text and label: mentions are read once for both."""
    return by_label.groupBy("text_norm").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("uris")))).alias("uris"), F.min("uri").alias("uri"))


def cascade(mentions: DataFrame, by_label: DataFrame, by_text: DataFrame) -> DataFrame:
    """uri and uri_source: by text and label, else by text, else NA (where a vector search may follow)."""
    made = mentions.withColumn("text_norm", normal(F.col("text_span")))
    made = made.join(by_label.select("text_norm", "label", F.col("uri").alias("_a")), ["text_norm", "label"], "left").join(by_text.select("text_norm", F.col("uri").alias("_b")), "text_norm", "left")
    source = F.when(F.col("_a").isNotNull(), "text_label").when(F.col("_b").isNotNull(), "text").otherwise("none")
    return made.withColumns({"uri": F.coalesce("_a", "_b", F.lit("NA")), "uri_source": source}).drop("_a", "_b")


def routed(mentions: DataFrame, by_label: DataFrame, by_text: DataFrame, search: Callable[[DataFrame], DataFrame], uris: DataFrame, threshold: float) -> DataFrame:
    """The whole cascade: uri, uri_source (text_label, text, similarity or none) and link_score of each mention.

    A mention leaves at the first stage that knows it. Only the texts that no exact stage knows, each once,
    reach `search`, which takes them (query_id: the text) and gives query_id, id, score of the nearest
    definitions; uris: id, uri. Below the threshold, or where the definition has no uri, it is NA.
    """
    # What a text with a label is linked to is told once, not a mention; mentions meet it once.
    own = mentions.drop("uri", "uri_source", "text_norm", "link_score")
    exact = cascade(own.select("text_span", "label").distinct(), by_label, by_text)
    rest = F.col("uri_source") == "none"
    texts = exact.filter(rest & F.col("text_span").isNotNull()).select(F.col("text_span").alias("query_id")).distinct()
    best = first_wins(search(texts).filter(F.col("score") >= threshold), ["query_id"], [F.desc("score"), "id"])
    best = best.join(uris.select("id", F.col("uri").alias("_uri")), "id").select(F.col("query_id").alias("_text"), "_uri", "score")
    met = exact.join(best, rest & (F.col("text_span") == F.col("_text")), "left")
    found = F.col("_uri").isNotNull()
    told = met.select(F.col("text_span").alias("_span"), F.col("label").alias("_label"), "text_norm", F.when(found, F.col("_uri")).otherwise(F.col("uri")).alias("uri"), F.when(found, "similarity").otherwise(F.col("uri_source")).alias("uri_source"), F.when(found, F.col("score")).alias("link_score"))
    return own.join(told, F.col("text_span").eqNullSafe(F.col("_span")) & F.col("label").eqNullSafe(F.col("_label"))).drop("_span", "_label")


def mention_reasons(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """name and reason ('counted' or why not) of each mention; the checks come in this order."""
    known = entities.join(dictionary.select(F.col("id").alias("uri"), "name"), "uri", "left")
    reason = F.when(F.col("text_span").isNull() | (F.trim("text_span") == ""), "missing_mention").when(F.col("uri").isNull() | F.col("uri").isin(NIL), "nil").when(F.col("name").isNull(), "unknown_uri").otherwise("counted")
    return known.withColumn("reason", reason)


def mention_counts(reasons: DataFrame) -> DataFrame:
    return reasons.filter("reason = 'counted'").groupBy(normal(F.col("text_span")).alias("mention"), "name").agg(F.count(F.lit(1)).alias("n"))


def prior_links(counts: DataFrame) -> DataFrame:
    """The most frequent name of each mention, ties to the first."""
    return first_wins(counts, ["mention"], [F.desc("n"), "name"])


def dictionary(rows: DataFrame, order: str) -> DataFrame:
    """The first row of each id; rows without id or name don't count."""
    return first_wins(rows.filter("trim(id) <> '' and trim(name) <> ''"), ["id"], [order])


def bm25(queries: DataFrame, documents: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, id, score of documents that share a term. queries: query_id, term; documents: id, term."""
    n = F.count(F.lit(1))
    tf = documents.groupBy("id", "term").agg(n.alias("tf"))
    size = documents.groupBy("id").agg(n.alias("size"))
    total = size.agg(n.alias("docs"), F.avg("size").alias("mean"))
    df = tf.groupBy("term").agg(n.alias("df"))
    hits = queries.select("query_id", "term").distinct().join(tf, "term").join(df, "term").join(size, "id").join(F.broadcast(total))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    return hits.groupBy("query_id", "id").agg(F.sum(part).alias("score"))


def reranked(candidates: DataFrame, first: str, second: str, k: int) -> DataFrame:
    """The best of each query's k best by `first`, by `second`; ties to the smaller id."""
    top = candidates.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(first), "id"))).filter(F.col("_n") <= k).drop("_n")
    return first_wins(top, ["query_id"], [F.desc(second), "id"])
