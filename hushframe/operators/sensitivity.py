"""Content sensitivity: flag words, category similarity, risk level and report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .. import constants as c
from ..functions.text import UNICODE_ANYCASE, cut, let, literal_map, quote, strip
from ..functions.vectors import cosine, histogram
from . import spans as sp

FLAG_TYPE = "struct<category:string,label:string,score:double,excerpt:string>"
FLAGS_TYPE = f"array<{FLAG_TYPE}>"
FLAG_PATTERN = UNICODE_ANYCASE + r"\b(?:" + "|".join(quote(w) for w in c.FLAG_WORDS) + r")\b"


def flag(category: Column, score: Column, excerpt: Column) -> Column:
    return F.struct(
        category.cast("string").alias("category"),
        F.element_at(literal_map(c.CATEGORY_LABELS), category).alias("label"),
        score.cast("double").alias("score"),
        excerpt.cast("string").alias("excerpt"),
    )


def keyword_flags(text: Column) -> Column:
    """A flag per distinct surrounding of a flag word."""
    hits = sp.scan(text, FLAG_PATTERN, "CREDENTIALS", c.FLAG_WORD_SCORE, "flag_word")

    def surrounding(s: Column) -> Column:
        return strip(
            cut(
                text,
                F.greatest(s["start"] - c.EXCERPT_BEFORE, F.lit(0)),
                F.least(s["end"] + c.EXCERPT_AFTER, F.length(text)),
            )
        )

    excerpts = F.array_distinct(F.transform(hits, surrounding))
    return F.transform(
        excerpts,
        lambda e: flag(F.lit("CREDENTIALS"), F.lit(c.FLAG_WORD_SCORE), F.left(e, F.lit(c.EXCERPT_MAX))),
    )


def chunks(text: Column, limit: int = c.CHUNK_CHARS) -> Column:
    """Lines of a text; lines over the limit are packed from whole sentences up to the limit."""

    def pack(line: Column) -> Column:
        def step(acc: Column, sentence: Column) -> Column:
            fits = F.length(acc["open"]) + F.length(sentence) + 1 <= limit
            return F.struct(
                F.when(fits | (acc["open"] == ""), acc["done"])
                .otherwise(F.concat(acc["done"], F.array(acc["open"])))
                .alias("done"),
                F.when(fits, strip(F.concat(acc["open"], F.lit(" "), sentence))).otherwise(sentence).alias("open"),
            )

        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
        return F.aggregate(
            F.split(line, r"(?U)(?<=[.!?])\s+"),
            start,
            step,
            lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(
                F.concat(acc["done"], F.array(acc["open"]))
            ),
        )

    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda line: line != "")
    parts = F.flatten(
        F.transform(lines, lambda line: F.when(F.length(line) <= limit, F.array(line)).otherwise(pack(line)))
    )
    return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.left(text, F.lit(limit)))))


SMALL_TABLE = 1000


def small_array(table: DataFrame, item: Column, name: str, most: int = SMALL_TABLE) -> Column:
    """A table of known small size as one array value; larger tables fail instead of growing.

    The array is cut one above the bound while it is built, so a table passed by mistake is refused without
    being gathered.
    """
    bounded = table.limit(most + 1).agg(F.collect_list(item).alias("__items"))
    fine = F.when(F.size("__items") <= most, F.col("__items")).otherwise(
        F.raise_error(F.lit(f"more than {most} rows given as {name}"))
    )
    return bounded.select(fine.alias(name)).scalar()


def category_flags(
    vectors: DataFrame, categories: DataFrame, keys: list[str], threshold: float = c.CATEGORY_THRESHOLD, most: int = SMALL_TABLE
) -> DataFrame:
    """Pairs of vector and category whose cosine exceeds the threshold; more than ``most`` categories are refused.

    ``categories(category, vector)`` has one row per category, seven in the default set, so it
    becomes one array value, its size checked, that every vector meets in place; the vectors are not shuffled.
    """
    cats = small_array(categories, F.struct("category", "vector"), "categories", most)
    scored = vectors.withColumn("cats", cats).select(
        *keys,
        F.explode(
            F.filter(
                F.transform(
                    "cats",
                    lambda x: F.struct(
                        x["category"].alias("category"), cosine(F.col("embedding"), x["vector"]).alias("similarity")
                    ),
                ),
                lambda x: x["similarity"] > threshold,
            )
        ).alias("hit"),
    )
    return scored.select(*keys, "hit.category", F.round("hit.similarity", 3).alias("score"))


def hashed_vector(text: Column, dims: int = 256) -> Column:
    """Default text encoder: counts of hashed words, JVM-side; texts share a direction if they share words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return histogram(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("bigint")), dims)


def model_encoder(make_predict: Callable, batch_size: int = 256) -> Callable[[Column], Column]:
    """An outside model as encoder: loaded once per Python worker, fed in Arrow batches."""
    udf = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return lambda text: udf(text)


def chunk_flags(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    encode: Callable[[Column], Column] = hashed_vector,
    threshold: float = c.CATEGORY_THRESHOLD,
) -> DataFrame:
    """(key, flags): category flags of all chunks of each text, in chunk and category order.

    Chunks are encoded and scored where their text is; only the hits are gathered per text.
    """
    names = list(c.CATEGORY_DESCRIPTIONS)
    described = df.sparkSession.createDataFrame(list(c.CATEGORY_DESCRIPTIONS.items()), "category string, d string")
    categories = described.select("category", encode(F.col("d")).alias("vector"))
    pieces = df.select(key, F.posexplode(chunks(F.col(text))).alias("chunk_no", "chunk"))
    vectors = pieces.withColumn("embedding", encode(F.col("chunk")))
    hits = category_flags(vectors, categories, [key, "chunk_no", "chunk"], threshold)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rows = hits.select(
        key, "chunk_no", F.element_at(place, F.col("category")).alias("at"), "category", "score",
        F.left("chunk", F.lit(c.EXCERPT_MAX)).alias("excerpt"),
    )
    return rows.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("chunk_no", "at", "category", "score", "excerpt"))),
            lambda x: flag(x["category"], x["score"], x["excerpt"]),
        ).alias("flags")
    )


def analyze(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    encode: Callable[[Column], Column] = hashed_vector,
    threshold: float = c.CATEGORY_THRESHOLD,
) -> DataFrame:
    """Report from the texts alone: flag words and encoded chunks."""
    flags = chunk_flags(df, key, text, encode, threshold).withColumnRenamed("flags", "__flags")
    return report(df.join(flags, key, "left"), text, "__flags").drop("__flags")


def by_score(flags: Column) -> Column:
    """Score descending, ties keep their order."""
    placed = F.transform(flags, lambda f, i: F.struct((-f["score"]).alias("rank"), i.alias("at"), f.alias("flag")))
    return F.transform(F.array_sort(placed), lambda p: p["flag"])


def risk(top: Column, count: Column) -> Column:
    """Risk from the best score and the number of flags."""
    return (
        F.when(count == 0, F.lit("low"))
        .when((top >= c.HIGH_RISK_SCORE) | (count >= 4), F.lit("high"))
        .when((count >= 2) | (top >= c.MEDIUM_RISK_SCORE), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def risk_level(flags: Column) -> Column:
    return risk(F.array_max(F.transform(flags, lambda f: f["score"])), F.size(flags))


def summary(text: Column, flags: Column, level: Column) -> Column:
    names = F.array_join(F.array_distinct(F.transform(flags, lambda f: f["label"])), ", ")
    high, other = c.SUMMARY_HIGH, c.SUMMARY_OTHER
    return (
        F.when(strip(F.coalesce(text, F.lit(""))) == "", F.lit(c.SUMMARY_BLANK))
        .when(F.size(flags) == 0, F.lit(c.SUMMARY_NONE))
        .when(level == "high", F.concat(F.lit(high[0]), names, F.lit(high[1])))
        .otherwise(F.concat(F.lit(other[0]), names, F.lit(other[1])))
    )


def report(df: DataFrame, text: str = "text", extra_flags: str | None = None) -> DataFrame:
    """Sensitivity report of each text; ``extra_flags`` names a column of category flags to join in."""
    body = F.col(text)
    none = F.array().cast(FLAGS_TYPE)
    words = F.coalesce(keyword_flags(body).cast(FLAGS_TYPE), none)
    flags = words if extra_flags is None else F.concat(words, F.coalesce(F.col(extra_flags).cast(FLAGS_TYPE), none))
    blank = strip(F.coalesce(body, F.lit(""))) == ""
    work = let(
        F.when(blank, none).otherwise(by_score(flags)),
        lambda f: let(
            F.struct(f.alias("flags"), risk_level(f).alias("level")),
            lambda w: F.struct(
                (F.size(w["flags"]) > 0).alias("is_sensitive"),
                w["level"].alias("risk_level"),
                w["flags"].alias("flags"),
                summary(body, w["flags"], w["level"]).alias("summary"),
            ),
        ),
    )
    out = df.withColumn("__report", work)
    fields = ("is_sensitive", "risk_level", "flags", "summary")
    return out.withColumns({f: F.col(f"__report.{f}") for f in fields}).drop("__report")


def centroids(vectors: DataFrame, kind: str = "label", vector: str = "embedding") -> DataFrame:
    """Unit mean vector per type as (kind, dim, value) rows; the zero vector is dropped.

    Means are taken per (type, dimension), combined before the shuffle, so a type that holds most rows
    is no burden.
    """
    dims = vectors.select(kind, F.posexplode(vector).alias("dim", "value"))
    means = dims.groupBy(kind, "dim").agg(F.avg(F.col("value").cast("double")).alias("mean"))
    length = means.groupBy(kind).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("length"))
    return (
        means.join(length, kind)
        .where(F.col("length") > 0)
        .select(kind, "dim", (F.col("mean") / F.col("length")).alias("value"))
    )


def centroid_vectors(rows: DataFrame, kind: str = "label") -> DataFrame:
    """The same as one array per type."""
    return rows.groupBy(kind).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("vector")
    )


def similar_to_any(
    vectors: DataFrame, centres: DataFrame, threshold: float = c.TERM_SIMILARITY, vector: str = "embedding", most: int = SMALL_TABLE
) -> DataFrame:
    """Rows whose vector is close to at least one centroid (one per type), each row once; more than ``most`` are refused."""
    return (
        vectors.withColumn("centres", small_array(centres, F.col("vector"), "centres", most))
        .where(F.exists("centres", lambda x: cosine(F.col(vector), x) > threshold))
        .drop("centres")
    )
