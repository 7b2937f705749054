"""Codenames: numbering of identifiers, rewriting of texts, mappings.

The same identifier (stripped, lower-cased) gets the same codename inside a scope.  With the scope
``document`` everything happens inside the row and nothing is shuffled.  Wider scopes (a conversation,
the corpus) number the distinct identifiers with a two-level count: a count per bucket of the reading
order, then a running offset over the few buckets, so no task ever holds all identifiers of a scope.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import POOL_OF_TYPE, POOLS
from ..functions.text import fold_key, let, literal_array, literal_map, walk
from ..session import stage
from . import spans as sp

#: Rows of one key that a task takes; see ``salted_join``.
HOT_ROWS = 500_000


def group_of(entity_type: Column) -> Column:
    """What is numbered together: the pool a type draws from, or the type itself."""
    return F.coalesce(F.element_at(literal_map(POOL_OF_TYPE), entity_type), entity_type)


def render(entity_type: Column, number: Column) -> Column:
    """Codename of the ``number``-th (from 1) identifier of its group."""
    pool = F.element_at(literal_map(POOL_OF_TYPE), entity_type)
    name = F.concat(F.lit("["), entity_type, F.lit("_"), number.cast("string"), F.lit("]"))
    for key, names in POOLS.items():
        size = len(names)
        index = (number - 1).cast("int")
        base = F.get(literal_array(names), index % size)
        lap = F.floor(index / size).cast("int")
        drawn = F.when(lap == 0, base).otherwise(
            F.concat(base, F.lit("-"), (lap + 1).cast("string"))
        )
        name = F.when(pool == key, drawn).otherwise(name)
    return name


def codenames(spans: Column) -> Column:
    """Codename of each span of one text, in the order of the spans (sorted by start).

    Sorting brings equal identifiers together, then the identifiers of a group in order of their first place, then
    the spans back in theirs; each step is a sort and a walk.
    """
    found = "struct<group:string,first:int,at:int,kind:string>"
    named = "struct<at:int,name:string>"
    entries = F.sort_array(
        F.transform(
            spans,
            lambda s, i: F.struct(fold_key(s["text"]).alias("key"), i.alias("at"), s["entity_type"].alias("kind")),
        )
    )

    def locate(state: Column, e: Column) -> tuple[Column, Column]:
        same = state["key"].eqNullSafe(e["key"]) & (state["first"] >= 0)
        after = F.struct(
            e["key"].alias("key"),
            F.when(same, state["first"]).otherwise(e["at"]).alias("first"),
            F.when(same, state["kind"]).otherwise(e["kind"]).alias("kind"),
        )
        out = let(
            after,
            lambda a: F.struct(
                group_of(a["kind"]).alias("group"), a["first"].alias("first"), e["at"].alias("at"), a["kind"].alias("kind")
            ),
        )
        return after, F.array(out)

    def number(state: Column, e: Column) -> tuple[Column, Column]:
        known = state["first"] == e["first"]
        count = (
            F.when(known, state["number"])
            .when(state["group"].eqNullSafe(e["group"]) & (state["first"] >= 0), state["number"] + 1)
            .otherwise(F.lit(1))
        )
        # An identifier's name is built at its first place and carried along.
        name = F.when(known, state["name"]).otherwise(let(count, lambda n: render(e["kind"], n)))
        after = F.struct(
            e["group"].alias("group"), e["first"].alias("first"), count.alias("number"), name.alias("name")
        )
        return after, F.array(F.struct(e["at"].alias("at"), name.alias("name")))

    nothing = F.lit(None).cast("string")
    placed = walk(
        entries, F.struct(nothing.alias("key"), F.lit(-1).alias("first"), nothing.alias("kind")), found, locate
    )
    start = F.struct(nothing.alias("group"), F.lit(-1).alias("first"), F.lit(0).alias("number"), nothing.alias("name"))
    names = walk(F.sort_array(placed), start, named, number)
    return F.transform(F.sort_array(names), lambda n: n["name"])


def mapping_of(spans: Column, names: Column) -> Column:
    """Codename to the last original written that way in the text, in order of the codenames' first places."""
    entries = F.sort_array(
        F.zip_with(
            F.transform(names, lambda n, i: F.struct(n.alias("name"), i.alias("at"))),
            spans,
            lambda n, s: F.struct(n["name"].alias("name"), n["at"].alias("at"), s["text"].alias("original")),
        )
    )

    def build(e: Column) -> Column:
        firsts = F.filter(e, lambda x, i: (i == 0) | ~F.get(e, i - 1)["name"].eqNullSafe(x["name"]))
        lasts = F.filter(e, lambda x, i: (i == F.size(e) - 1) | ~F.get(e, i + 1)["name"].eqNullSafe(x["name"]))
        pairs = F.sort_array(
            F.zip_with(
                firsts,
                lasts,
                lambda a, b: F.struct(a["at"].alias("at"), a["name"].alias("name"), b["original"].alias("original")),
            )
        )
        return let(
            pairs,
            lambda p: F.map_from_arrays(
                F.transform(p, lambda x: x["name"]), F.transform(p, lambda x: x["original"])
            ),
        )

    return let(entries, build)


def anonymized(text: Column, spans: Column) -> Column:
    """One text rewritten: struct of ``anonymized``, ``mapping``, ``resolved`` spans and their ``names``."""

    def rewrite(w: Column) -> Column:
        return let(
            codenames(w["spans"]),
            lambda n: F.struct(
                sp.splice(w["text"], w["spans"], n).alias("anonymized"),
                mapping_of(w["spans"], n).alias("mapping"),
                w["spans"].alias("resolved"),
                n.alias("names"),
            ),
        )

    return let(F.struct(text.alias("text"), sp.resolve_overlaps(spans).alias("spans")), rewrite)


def anonymize(
    df: DataFrame, text: str = "text", spans: str = "spans", *, keep_spans: bool = False
) -> DataFrame:
    """Rewrite each text on its own: adds ``anonymized`` and ``mapping``; no shuffle."""
    out = df.withColumn("__done", anonymized(F.col(text), F.col(spans)))
    fields = ["anonymized", "mapping", *(["resolved", "names"] if keep_spans else [])]
    return out.withColumns({f: F.col(f"__done.{f}") for f in fields}).drop("__done")


def mapping_rows(df: DataFrame, keys: Sequence[str], mapping: str = "mapping") -> DataFrame:
    """Vault form of the mappings: one row per codename."""
    entries = F.coalesce(F.map_entries(mapping), F.array().cast("array<struct<key:string,value:string>>"))
    return df.select(*keys, F.explode(entries).alias("e")).select(
        *keys, F.col("e.key").alias("codename"), F.col("e.value").alias("original")
    )


# ---------------------------------------------------------------- wider scopes


def first_seen(occurrences: DataFrame, scope: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per scope and identifier: where and as what type it first occurs.

    ``min_by`` is combined before the shuffle, so a key that fills a third of the rows costs one row per
    task.
    """
    place = F.struct(*[F.col(c) for c in order], F.col("entity_type"))
    firsts = occurrences.groupBy(*scope, "key").agg(F.min(place).alias("first"))
    return firsts.select(
        *scope, "key", *[F.col(f"first.{c}").alias(c) for c in order], F.col("first.entity_type").alias("entity_type")
    )


def number_groups(
    firsts: DataFrame, scope: Sequence[str], order: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """Running number per (scope, group) without gathering a group in one task.

    Rows are numbered inside (scope, group, bucket); the bucket totals are small and give each bucket its offset.
    Without ``bucket`` the buckets are the parts of a range partition by scope and order, whatever the values are; one that
    is given must not decrease along ``order``.
    """
    keys = [*scope, "group"]
    rows = firsts.withColumn("group", group_of(F.col("entity_type")))
    if bucket is None:
        parts = int(firsts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = rows.repartitionByRange(parts, *[F.col(c) for c in [*scope, *order]])
        # Written, so that every later step sees the same parts.
        rows = stage(ranged.withColumn("bucket", F.spark_partition_id()), "numbering")
    else:
        rows = rows.withColumn("bucket", bucket)
    inner = W.partitionBy(*keys, "bucket").orderBy(*order)
    local = rows.withColumn("local", F.row_number().over(inner))
    totals = rows.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    return (
        local.join(offsets, [*keys, "bucket"])
        .withColumn("number", F.col("local") + F.col("before"))
        .drop("local", "before", "bucket")
    )


def codebook(
    occurrences: DataFrame, scope: Sequence[str], order: Sequence[str], bucket: Column | None = None
) -> DataFrame:
    """(scope, key, entity_type, number, codename) of every identifier of each scope."""
    firsts = first_seen(occurrences, scope, order)
    numbered = number_groups(firsts, scope, order, bucket)
    return numbered.withColumn("codename", render(F.col("entity_type"), F.col("number"))).select(
        *scope, "key", "entity_type", "group", "number", "codename"
    )


def salted_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], spread: Column, how: str = "inner", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join where one key may hold a large share of ``left``; ``right`` is unique on ``on``.

    Keys are counted first.  The rows of a key with more than ``hot_rows`` are spread by ``spread`` over as many parts as
    its size asks for, and only the right rows of those keys are repeated; all others join as they are.
    """
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows)
    # At most one row for each ``hot_rows`` rows of ``left``.
    hot = F.broadcast(counted.select(*on, F.ceil(F.col("__n") / hot_rows).cast("int").alias("__parts")))
    salt = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(spread), F.col("__parts"))).cast("int")
    parts = left.join(hot, list(on), "left").withColumn("__salt", salt).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__parts"), F.lit(1)) - 1))
    repeated = right.join(hot, list(on), "left").withColumn("__salt", copies).drop("__parts")
    return parts.join(repeated, [*on, "__salt"], how).drop("__salt")


def anonymize_scoped(
    df: DataFrame,
    ids: Sequence[str],
    scope: Sequence[str],
    order: Sequence[str],
    bucket: Column | None = None,
    text: str = "text",
    spans: str = "spans",
) -> tuple[DataFrame, DataFrame]:
    """Rewrite texts with codenames shared across a scope; returns (texts, codebook).

    ``ids`` identify a text and include the scope columns; ``order`` is the reading order of the texts
    inside a scope.  Detection runs once: its spans, a small share of the texts, are written to the shared
    folder, and the numbering works on that table.  The texts are then read again and meet their codenames
    in one join on ``ids``, whose groups are as small as one text.
    """
    columns = list(dict.fromkeys([*ids, *order]))
    resolved = sp.resolve_overlaps(F.col(spans))
    numbered = F.transform(
        resolved,
        lambda s, i: F.struct(
            i.alias("idx"), s["start"].alias("start"), s["end"].alias("end"),
            s["entity_type"].alias("entity_type"), s["text"].alias("original"), fold_key(s["text"]).alias("key"),
        ),
    )
    occurrences = stage(df.select(*columns, F.inline(numbered)), "occurrences")
    # The codebook serves the texts and the vault.
    book = stage(codebook(occurrences, scope, [*order, "start"], bucket), "codebook")
    named = salted_join(
        occurrences.select(*ids, "start", "end", "key"), book.select(*scope, "key", "codename"),
        [*scope, "key"], F.struct(*[F.col(c) for c in ids]),
    )
    per_text = named.groupBy(*ids).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "codename"))).alias("__named")
    )
    joined = df.drop(spans).join(per_text, list(ids), "left")
    places = F.coalesce(
        F.col("__named"), F.array().cast("array<struct<start:int,end:int,codename:string>>")
    )
    rewritten = sp.splice(F.col(text), places, F.transform(places, lambda s: s["codename"]))
    # The last spelling in reading order is the one restored.
    place = F.struct(*[F.col(c) for c in order], F.col("start"))
    spelled = occurrences.groupBy(*scope, "key").agg(F.max_by("original", place).alias("original"))
    out = joined.withColumn("anonymized", rewritten).drop("__named")
    return out, book.join(spelled, [*scope, "key"])
