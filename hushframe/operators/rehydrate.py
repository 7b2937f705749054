"""Putting originals back: exact, any-case and tolerant matching of codenames.

One response row carries the map of its session.  The three passes are folds over the map entries,
longest codename first; the regular-expression passes run only for codenames whose letters occur in the
text at all.  Of a large map only the entries that the text can need are tried.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SESSION_TTL_SECONDS
from ..functions.text import html_escape, let, quoted, replacement, walk
from ..session import stage
from .pseudonym import salted_join

ENTRIES = "array<struct<key:string,value:string>>"


def no_entries() -> Column:
    return F.array().cast(ENTRIES)


def entries_of(mapping: Column) -> Column:
    """Map entries, longest codename first, ties by name."""
    return longest_first(F.coalesce(F.map_entries(mapping).cast(ENTRIES), no_entries()))


def longest_first(entries: Column) -> Column:
    keyed = F.transform(entries, lambda e: F.struct((-F.length(e["key"])).alias("n"), e.alias("entry")))
    return F.transform(F.sort_array(keyed), lambda k: k["entry"])


def _folded(text: Column) -> Column:
    """Lower case with the one letter that only ignore-case matching equates with a plain one."""
    return F.translate(F.lower(text), "ſ", "s")


def _pass(state: Column, hit, swap) -> Column:
    """One pass: replace where ``hit``; entries that found nothing stay for the next pass.

    ``hit`` gets the text, its folded form and the codename; the folded form is made anew only where the text changes.
    """

    def step(acc: Column, entry: Column) -> Column:
        found = hit(acc["text"], acc["low"], entry["key"])
        changed = let(swap(acc["text"], entry), lambda t: F.struct(t.alias("text"), _folded(t).alias("low"), acc["rest"].alias("rest")))
        kept = F.struct(acc["text"].alias("text"), acc["low"].alias("low"), F.concat(acc["rest"], F.array(entry)).alias("rest"))
        return F.when(found, changed).otherwise(kept)

    return let(
        state,
        lambda s: F.aggregate(
            s["rest"], F.struct(s["text"].alias("text"), _folded(s["text"]).alias("low"), no_entries().alias("rest")), step
        ),
    )


def any_case_pattern(key: Column) -> Column:
    return F.concat(F.lit("(?iu)"), quoted(key))


def tolerant_pattern(key: Column) -> Column:
    """Optional square or round brackets, one blank inside, any single separator between the parts."""
    inner = F.regexp_replace(key, r"^[\[\]]+|[\[\]]+$", "")
    parts = F.transform(F.split(inner, "_"), quoted)
    return F.concat(
        F.lit(r"(?iuU)[\[\(]?\s?"), F.array_join(parts, r"[\s_\-]?"), F.lit(r"\s?[\]\)]?")
    )


def exact_pass(state: Column) -> Column:
    return _pass(state, lambda t, low, k: t.contains(k), lambda t, e: F.replace(t, e["key"], e["value"]))


def any_case_pass(state: Column) -> Column:
    return _pass(
        state,
        lambda t, low, k: low.contains(_folded(k)) & F.rlike(t, any_case_pattern(k)),
        lambda t, e: F.regexp_replace(t, any_case_pattern(e["key"]), replacement(e["value"])),
    )


def tolerant_pass(state: Column) -> Column:
    def hit(text: Column, low: Column, key: Column) -> Column:
        inner = F.regexp_replace(key, r"^[\[\]]+|[\[\]]+$", "")
        return low.contains(_folded(F.get(F.split(inner, "_"), F.lit(0)))) & F.rlike(text, tolerant_pattern(key))

    return _pass(
        state, hit, lambda t, e: F.regexp_replace(t, tolerant_pattern(e["key"]), replacement(e["value"]))
    )


#: Entries of a map that are tried one after the other; of a larger one only those that the text can need.
FEW = 64


def needed_entries(text: Column, mapping: Column) -> Column:
    """The entries whose codename a text, or an original that may be put into it, can hold in any way of matching.

    The forms that stand in the text are found by the few stems of the codenames and meet those of the map by sorting, so the
    work grows with the text and the map, not with their product.
    """

    def reduced(entries: Column) -> Column:
        forms = F.transform(entries, lambda e: F.struct(squeezed(e["key"]).alias("form"), F.lit(1).alias("kind"), e.alias("entry")))
        stems = F.array_distinct(F.transform(entries, lambda e: stem_of(e["key"])))
        body = F.concat_ws("\n", text, F.array_join(F.transform(entries, lambda e: e["value"]), "\n"))
        none = F.lit(None).cast("struct<key:string,value:string>")
        there = F.transform(candidate_keys(body, stems), lambda f: F.struct(f.alias("form"), F.lit(0).alias("kind"), none.alias("entry")))

        def step(last: Column, x: Column) -> tuple[Column, Column]:
            hit = (x["kind"] == 1) & x["form"].eqNullSafe(last)
            return F.when(x["kind"] == 0, x["form"]).otherwise(last), F.when(hit, F.array(x["entry"])).otherwise(no_entries())

        return walk(F.sort_array(F.concat(there, forms)), F.lit(None).cast("string"), "struct<key:string,value:string>", step)

    found = F.coalesce(F.map_entries(mapping).cast(ENTRIES), no_entries())
    return let(found, lambda e: F.when(F.size(e) <= FEW, e).otherwise(reduced(e)))


def _state(text: Column, mapping: Column) -> Column:
    return F.struct(text.alias("text"), longest_first(needed_entries(text, mapping)).alias("rest"))


def rehydrate_exact(text: Column, mapping: Column) -> Column:
    return exact_pass(_state(text, mapping))["text"]


def rehydrate(text: Column, mapping: Column) -> Column:
    """All three passes."""
    return tolerant_pass(any_case_pass(exact_pass(_state(text, mapping))))["text"]


def replacements_made(text: Column, mapping: Column) -> Column:
    """How many codenames of the map occur in the text, in any case."""
    low = F.lower(text)
    keys = F.coalesce(F.map_keys(mapping), F.array().cast("array<string>"))
    return let(low, lambda t: F.size(F.filter(keys, lambda k: t.contains(F.lower(k))))).cast("bigint")


def rehydrate_json(body: Column, mapping: Column) -> Column:
    """Restore inside a JSON document; every field stays as it is written.

    Originals go in as JSON string contents, so one with quotes or line breaks is safe.
    """
    escaped = F.transform(
        entries_of(mapping),
        lambda e: F.struct(
            e["key"].alias("key"),
            let(F.to_json(F.array(e["value"])), lambda q: F.substring(q, F.lit(3), F.length(q) - 4)).alias("value"),
        ),
    )
    return F.aggregate(escaped, body, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def highlight(text: Column, originals: Column) -> Column:
    """Escape a restored text and mark each distinct original longer than one character."""
    distinct = F.array_distinct(F.filter(originals, lambda v: F.length(v) > 1))

    def step(acc: Column, value: Column) -> Column:
        safe = html_escape(value)
        marked = F.concat(F.lit('<span class="rehydrated-mark">'), safe, F.lit("</span>"))
        return F.replace(acc, safe, marked)

    return F.aggregate(F.coalesce(distinct, F.array().cast("array<string>")), html_escape(text), step)


# ------------------------------------------------------------------ answers and the vault table

SEPARATORS = r"(?U)[\s_\-\[\]()]+"


def squeezed(text: Column) -> Column:
    """Lower case without separators and brackets.

    However a codename is found, exactly, in another case or tolerantly, its squeezed form is part of the
    squeezed text.
    """
    return _folded(F.regexp_replace(text, SEPARATORS, ""))


def stem_of(codename: Column) -> Column:
    """What a codename begins with: its squeezed form without the digits at its end."""
    return F.regexp_replace(squeezed(codename), r"\p{Nd}+$", "")


def candidate_keys(text: Column, stems: Column) -> Column:
    """Squeezed forms of all codenames a text may hold: each known stem with each lead of the digits behind it.

    Every stem is looked for at every place, so overlapping names all count; the list is bounded by the text.
    """

    def keys_of(body: Column, stem: Column) -> Column:
        runs = F.regexp_extract_all(body, F.concat(F.lit("(?="), quoted(stem), F.lit(r"(\p{Nd}*))")), F.lit(1))
        return F.flatten(
            F.transform(
                F.array_distinct(runs),
                lambda d: F.transform(F.sequence(F.lit(0), F.length(d)), lambda n: F.concat(stem, F.left(d, n))),
            )
        )

    def keys(body: Column) -> Column:
        present = F.filter(stems, lambda s: body.contains(s))
        return F.array_distinct(F.flatten(F.transform(present, lambda s: keys_of(body, s))))

    return let(squeezed(text), keys)


def latest(vault: DataFrame, scope: Sequence[str]) -> DataFrame:
    """One row per (scope, codename): a repeated write counts once, the last spelling wins."""
    last = F.max_by("original", F.struct("created_at", "original")) if "created_at" in vault.columns else F.max("original")
    return vault.groupBy(*scope, "codename").agg(last.alias("original"))


#: One spelling of a codename with the time of its write.
VERSIONS = "array<struct<codename:string,created_at:timestamp,original:string>>"


def period(moment: Column, ttl: int) -> Column:
    """Number of the lifetime-long period that a moment lies in: what lives at a moment was written in its own or the one before."""
    return F.floor(F.unix_micros(moment) / (ttl * 1_000_000)).cast("long")


def periods(moment: Column, ttl: int) -> Column:
    return let(period(moment, ttl), lambda n: F.array(n - 1, n))


def alive(written: Column, moment: Column, ttl: int) -> Column:
    """Whether something written then lives at a moment: not written later, and no older than the lifetime."""
    age = F.unix_micros(moment) - F.unix_micros(written)
    return (age >= 0) & (age <= ttl * 1_000_000)


def _last_spellings(versions: Column, moment: Column, ttl: int) -> Column:
    """Codename to its last spelling that lives at a moment."""
    live = F.array_sort(F.filter(versions, lambda v: alive(v["created_at"], moment, ttl)))
    lasts = let(
        live, lambda e: F.filter(e, lambda v, i: (i == F.size(e) - 1) | (F.get(e, i + 1)["codename"] != v["codename"]))
    )
    return F.map_from_entries(F.transform(lasts, lambda v: F.struct(v["codename"], v["original"])))


def attach_mappings(
    responses: DataFrame,
    vault: DataFrame,
    ids: Sequence[str],
    scope: Sequence[str] = ("session_id",),
    text: str = "text",
    stems: str | None = None,
    moment: str | None = None,
    ttl: int = SESSION_TTL_SECONDS,
) -> DataFrame:
    """Adds ``mapping``: the part of its scope's vault rows that a response can need.

    Responses and vault rows meet on (scope, squeezed codename), so a scope with a third of all vault
    rows, or one whole corpus as a scope, is spread over all tasks, and a response gathers no more
    codenames than its text can hold.  ``stems`` names a column with the codename stems of the response's scope; without it
    they are joined in.  With ``moment`` (a column of times) each codename has the last spelling that lives then; rows also
    meet on the period of their write, so a key holds no more than was written to it in one lifetime.
    """
    if stems is None:
        known = vault.groupBy(*scope).agg(F.collect_set(stem_of(F.col("codename"))).alias("__stems"))
        responses_ = salted_join(responses, known, scope, F.struct(*[F.col(c) for c in ids]), how="left")
    else:
        responses_ = responses.withColumn("__stems", F.col(stems))
    keys = candidate_keys(F.col(text), F.coalesce("__stems", F.array().cast("array<string>")))
    spread = F.struct(*[F.col(c) for c in ids])
    # An id may be a column of the scope.
    named = list(dict.fromkeys([*ids, *scope]))
    if moment is None:
        # Written: the join counts its keys before it deals them out, and they are costly to find.
        asked = stage(responses_.select(*named, F.explode(keys).alias("__key")), "asked")
        rows = latest(vault, scope).withColumn("__key", squeezed(F.col("codename")))
        by_key = rows.groupBy(*scope, "__key").agg(F.collect_list(F.struct("codename", "original")).alias("__rows"))
        met = salted_join(asked, by_key, [*scope, "__key"], spread)
        maps = met.groupBy(*ids).agg(F.map_from_entries(F.flatten(F.collect_list("__rows"))).alias("mapping"))
    else:
        asked = stage(responses_.select(*named, F.explode(keys).alias("__key"), F.col(moment).alias("__moment")), "asked")
        asked = asked.withColumn("__period", F.explode(periods(F.col("__moment"), ttl)))
        rows = vault.select(
            *scope, squeezed(F.col("codename")).alias("__key"), period(F.col("created_at"), ttl).alias("__period"),
            F.struct("codename", "created_at", "original").alias("row"),
        )
        # A set: a write that came twice counts once, before the shuffle already.
        by_key = rows.groupBy(*scope, "__key", "__period").agg(F.collect_set("row").alias("__rows"))
        met = salted_join(asked, by_key, [*scope, "__key", "__period"], spread)
        maps = met.groupBy(*ids, "__moment").agg(F.flatten(F.collect_list("__rows")).cast(VERSIONS).alias("rows"))
        maps = maps.select(*ids, _last_spellings(F.col("rows"), F.col("__moment"), ttl).alias("mapping"))
    joined = responses.join(maps, list(ids), "left")
    none = F.create_map().cast("map<string,string>")
    return joined.withColumn("mapping", F.coalesce(F.col("mapping"), none))


def rehydrate_sessions(
    responses: DataFrame, vault: DataFrame, ids: Sequence[str], ttl: int = SESSION_TTL_SECONDS
) -> DataFrame:
    """Responses with their originals; ``status`` is ``missing`` for unknown and too old sessions.

    ``responses(ids, session_id, text, asked_at)``, ``vault(session_id, codename, original, created_at)`` and, in a vault
    that is partitioned by it, ``day``.  An entry lives from its write to the end of its lifetime, a session as long as one
    of its entries: what counts at a question is what was written up to then and not too long before, and of one codename
    the last spelling.  Only vault rows from the first question less the lifetime to the last question, of sessions that
    are asked for, are read further; whether a session is alive is decided on ids alone.
    """
    span_ = responses.agg(F.min("asked_at").alias("first"), F.max("asked_at").alias("last")).first()
    if span_["first"] is not None:
        edge = F.lit(span_["first"]) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl))
        near = (F.col("created_at") >= edge) & (F.col("created_at") <= F.lit(span_["last"]))
        if "day" in vault.columns:
            near = near & (F.col("day") >= F.to_date(edge)) & (F.col("day") <= F.to_date(F.lit(span_["last"])))
        vault = vault.where(near)
    asked = responses.select(*ids, "session_id", "asked_at")
    vault = vault.join(asked.select("session_id").distinct(), "session_id", "left_semi")
    # The times of a session's writes within one lifetime.
    opened = vault.groupBy("session_id", period(F.col("created_at"), ttl).alias("__period")).agg(
        F.collect_set("created_at").alias("__writes"), F.collect_set(stem_of(F.col("codename"))).alias("__stems")
    )
    met = salted_join(
        asked.withColumn("__period", F.explode(periods(F.col("asked_at"), ttl))), opened, ["session_id", "__period"],
        F.struct(*[F.col(c) for c in ids]),
    )
    checked = met.where(F.exists("__writes", lambda w: alive(w, F.col("asked_at"), ttl)))
    checked = checked.groupBy(*ids).agg(F.array_distinct(F.flatten(F.collect_list("__stems"))).alias("__known"))
    live = responses.join(checked, list(ids), "left")
    mapped = attach_mappings(live, vault, ids, stems="__known", moment="asked_at", ttl=ttl)
    open_ = F.col("__known").isNotNull()
    return mapped.select(
        *responses.columns,
        F.when(open_, F.lit("ok")).otherwise(F.lit("missing")).alias("status"),
        F.when(open_, rehydrate(F.col("text"), F.col("mapping"))).alias("rehydrated_text"),
        F.when(open_, replacements_made(F.col("text"), F.col("mapping"))).alias("replacements_made"),
    )
