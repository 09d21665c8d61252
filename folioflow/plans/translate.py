"""Translation plan: glossary, batches, cache, prompts, client, attach."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as t
from folioflow.operators import merge, order, rounds
from folioflow.plans import fitting
from folioflow.sources.pages import glossary_fingerprint  # noqa: F401 - part of this plan

MOST_TERMS = 60


def glossary_section(glossary: Column) -> Column:
    """Prompt lines of a glossary ``struct<terms map, note, banned array>``; empty without one."""
    terms, banned = F.slice(F.map_entries(glossary["terms"]), 1, MOST_TERMS), F.slice(glossary["banned"], 1, MOST_TERMS)
    listed = F.array_join(F.transform(terms, lambda e: F.concat(e["key"], F.lit(" -> "), e["value"])), "; ")
    lines = F.array_compact(F.array(
        F.when(F.size(terms) > 0, F.concat(F.lit("Terms: "), listed)),
        F.when(t.strip(glossary["note"]) != "", F.concat(F.lit("Context: "), t.strip(glossary["note"]))),
        F.when(F.size(banned) > 0, F.concat(F.lit("Never use: "), F.array_join(banned, ", "))),
    ))
    return F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


def with_glossary(pages: DataFrame, glossaries: DataFrame) -> DataFrame:
    """Adds the ``glossary`` of each page's comic; null where there is none. One row for each comic is a small table."""
    return pages.join(glossaries.select("comic", "glossary"), "comic", "left")


def remembered(cache: DataFrame, edits: DataFrame, source: str, target: str, fingerprint: str = "") -> DataFrame:
    """The cache with a person's translations in place of what it held: the last by ``seq`` of each text.

    ``edits``: ``seq, original, translated``; rows with either side blank teach nothing.
    """
    original, said = (t.strip(F.coalesce(c, F.lit(""))) for c in ("original", "translated"))
    key = t.cache_key(F.lit(source), F.lit(target), F.concat(original, F.lit(fingerprint)))
    taught = edits.where((original != "") & (said != "")).select(key.alias("key"), said.alias("translation"), "seq")
    return merge.upsert(cache, taught.groupBy("key").agg(F.max_by("translation", "seq").alias("translation")), ["key"])


def prompts(rows: DataFrame, page: str, pos: str, text: str, size: int = 10) -> DataFrame:
    """One prompt text for each batch of ``size`` rows with text of a page."""
    said = rows.where(t.strip(F.coalesce(text, F.lit(""))) != "")
    line = F.struct(F.col(pos).alias("pos"), t.prompt_line(F.col(pos), F.col(text)).alias("line"))
    return order.batches(said, page, pos, size).groupBy(page, "batch").agg(
        F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"),
    )


#: What a prompt asks for before the lines of a batch; ``{source}`` and ``{target}`` are languages.
RULES = (
    "Translate these {source} comic dialogue lines to {target}.\n"
    "Keep who does what to whom, the tone, the register and the profanity.\n"
    "Translate what idioms mean; where no natural equivalent comes to mind, translate literally.\n"
    "Check spelling and grammar of your own lines.\n"
    "Give only the translations, one line for each input line, with the same [balloon N] tags:"
)


def prompt_text(lines: Column, glossary: Column, source: str, target: str, rules: str = RULES) -> Column:
    """A whole prompt: the rules, the glossary of the comic, then the lines."""
    return F.concat(F.lit(rules.format(source=source, target=target)), glossary_section(glossary), F.lit("\n\n"), lines)


NO_GLOSSARY = "struct<terms:map<string,string>,note:string,banned:array<string>>"


def translate(
    rows: DataFrame, cache: DataFrame, client: Callable[[str], str], source: str, target: str, page: str = "page_id", *,
    glossaries: DataFrame | None = None, force: bool = False, rules: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Translated rows, and what the cache gains.

    Texts of a page go in batches of ten. Known ones never reach the client, unless
    ``force``; a batch without others is not sent. ``client`` maps a prompt to a tagged
    reply and runs in tasks; where it fails, that batch's rows stay untranslated and the
    others are not touched. With ``glossaries`` (``comic, glossary, fingerprint``), rows
    carry ``comic``: a glossary goes into its prompts and its mark into the cache keys.
    ``rules`` (``RULES`` if there are glossaries) stand before the lines. Answers to
    balloons that were not asked for do not count; of repeated answers the last one does.
    """
    if glossaries is not None:
        known = glossaries.select("comic", "glossary", F.col("fingerprint").alias("_mark"))
        rows_in = rows.join(known, "comic", "left")
        rules = RULES if rules is None else rules
    else:
        rows_in = rows.withColumns({"glossary": F.lit(None).cast(NO_GLOSSARY), "_mark": F.lit("")})
    said = order.batches(rows_in.where(t.strip(F.coalesce("original", F.lit(""))) != ""), page, "pos")
    marked = F.concat("original", F.coalesce("_mark", F.lit("")))
    keyed = said.withColumn("key", t.cache_key(F.lit(source), F.lit(target), marked))
    looked = merge.cache_lookup(keyed, cache.limit(0) if force else cache)
    asked = looked.where(~F.col("hit"))
    line = F.struct("pos", t.prompt_line(F.col("pos"), F.col("original")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n")
    batched = asked.groupBy(page, "batch").agg(lines.alias("lines"), F.first("glossary").alias("glossary"))
    whole = F.col("lines") if rules is None else prompt_text(F.col("lines"), F.col("glossary"), source, target, rules)
    prompt = batched.select(page, "batch", whole.alias("prompt"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for text in frame["prompt"]:
                try:
                    replies.append(client(text))
                except Exception:  # noqa: BLE001 - any failure of a client costs its batch only
                    replies.append(None)
            yield frame[[page, "batch"]].assign(reply=pd.Series(replies, index=frame.index, dtype=object))

    types = dict(prompt.dtypes)
    replies = rounds.written(prompt.mapInPandas(call, f"{page} {types[page]}, batch {types['batch']}, reply string"), "replies")  # asked once
    tagged = replies.select(page, "batch", F.posexplode(t.tagged_lines(F.col("reply"))).alias("line", "a"))
    answers = tagged.groupBy(page, "batch", F.col("a.id").alias("pos")).agg(F.max_by("a.text", "line").alias("answer"))
    done = looked.join(answers, [page, "batch", "pos"], "left").select(page, "pos", "key", "hit", F.coalesce("translation", "answer").alias("translated"))
    gained = done.where(~F.col("hit") & F.col("translated").isNotNull()).select("key", F.col("translated").alias("translation"))
    gained = gained.groupBy("key").agg(F.min("translation").alias("translation"))
    return merge.attach(rows.drop("translated"), done, [page, "pos"], "translated"), gained


def translate_pages(
    rows: DataFrame, cache: DataFrame, client: Callable[[str], str], source: str, target: str, *, glossaries: DataFrame | None = None, force: bool = False,
    shorter: Callable[[str, int, str], str] | None = None, table: dict[str, int] | None = None, page: str = "page_id",
) -> tuple[DataFrame, DataFrame]:
    """The whole step for pages: ``translate``, then shorter texts where they do not fit (``fitting.shorten``).

    The cache gains what the client said, not the shortened text: it depends on the
    balloon. Without ``shorter`` nothing is shortened. ``shortened`` tells where it was.
    """
    done, gained = translate(rows, cache, client, source, target, page, glossaries=glossaries, force=force, rules=RULES)
    if shorter is None:
        return done.withColumn("shortened", F.lit(False)), gained
    return fitting.shorten(done, shorter, table or {}, page), gained
