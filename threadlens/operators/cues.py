"""Risk cues of a conversation, with the words that show them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions import text as T


def _pattern(alternatives: list[str]) -> str:
    return "(?i)" + "|".join(alternatives)


def evidence(message: Column, context: Column) -> Column:
    """array<struct<cue, matched, source>>: a row for each cue that shows, in the order of the library, prior_clarification last.

    message: the customer's text; context: the turns before, oldest first, array<struct<role, text>>. A cue is looked for in the
    message, then in the customer's own earlier turns; brand turns show only that the brand asked for details. matched: at most 60
    characters. Null texts and contexts show nothing.
    """
    own = F.filter(F.coalesce(context, F.array().cast("array<struct<role:string,text:string>>")), lambda t: t["role"].startswith("customer"))
    brand = F.filter(F.coalesce(context, F.array().cast("array<struct<role:string,text:string>>")), lambda t: t["role"] == "brand")
    short = lambda t: F.substring(F.trim(t), 1, 60)

    def one(cue: str, matched: Column, source: Column) -> Column:
        return F.when(matched.isNotNull(), F.struct(F.lit(cue).alias("cue"), short(matched).alias("matched"), source.alias("source")))

    def words(cue: str) -> Callable[[Column], Column]:
        return lambda text: F.nullif(F.regexp_extract(text, _pattern(T.CUES[cue]), 0), F.lit(""))

    def earlier(said: Callable[[Column], Column]) -> Column:
        return F.get(F.filter(F.transform(own, lambda t: said(t["text"])), lambda m: m.isNotNull()), 0)

    found = []
    for cue in T.CUES:
        here, before = words(cue)(message), earlier(words(cue))
        found.append(one(cue, F.coalesce(here, before), F.when(here.isNotNull(), "message").otherwise("customer_context")))
    asked = F.get(F.filter(brand, lambda t: F.coalesce(t["text"].rlike("(?i)" + T.BRAND_ASKS), F.lit(False))), 0)
    found.append(one("prior_clarification", asked["text"], F.lit("brand_context")))
    return F.array_compact(F.array(*found))


def flags(shown: Column) -> dict[str, Column]:
    """A boolean for each cue, for the policy, from the evidence."""
    return {c: F.array_contains(F.transform(shown, lambda e: e["cue"]), c) for c in [*T.CUES, "prior_clarification"]}


def legacy_flags(message: Column, context: Column) -> dict[str, Column]:
    """The keyword baseline's cues: its patterns on the message alone, and a question in the last turn if that is the brand's."""
    last = F.get(context, F.size(context) - 1)
    asked = F.coalesce((last["role"] == "brand") & last["text"].contains("?"), F.lit(False))
    return {c: F.coalesce(message.rlike("(?i)" + p), F.lit(False)) for c, p in T.LEGACY_CUES.items()} | {"prior_clarification": asked}
