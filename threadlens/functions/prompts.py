"""Prompts as Column expressions: the same row always gives the same text. Models themselves are external."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turns_block(turns: Column) -> Column:
    """turns: array of (role, text), oldest first; an empty one is named as such."""
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), F.coalesce(t["text"], F.lit("")))), "\n")
    return F.when(F.size(turns) > 0, lines).otherwise("No turns before this one.")


def evidence_block(found: Column) -> Column:
    """found: array of (record_id, sim, asked, replied), best first. None is named as such; one whose texts are blank raises."""
    blank = F.exists(found, lambda x: (F.trim(F.coalesce(x["asked"], F.lit(""))) == "") | (F.trim(F.coalesce(x["replied"], F.lit(""))) == ""))
    one = lambda x: F.concat_ws(
        "\n", F.format_string("[%s] likeness %.2f", x["record_id"].cast("string"), x["sim"].cast("double")),
        F.concat(F.lit("customer: "), x["asked"]), F.concat(F.lit("brand: "), x["replied"]),
    )
    lines = F.array_join(F.transform(found, one), "\n")
    none = F.lit("Nothing similar was found.")
    return F.when(blank, F.raise_error(F.lit("blank evidence"))).when(F.size(found) > 0, lines).otherwise(none)


def routing_prompt(message: Column, turns: Column) -> Column:
    ask = "Name the state, the intent if the state has one, each cue as true or false, and a confidence from 0 to 1."
    return F.concat_ws("\n\n", F.lit("EARLIER TURNS"), turns_block(turns), F.lit("MESSAGE"), message, F.lit(ask))


def draft_prompt(message: Column, turns: Column, found: Column, errors: Column) -> Column:
    """errors: array of what was wrong with the draft before; empty for a first draft."""
    listed = F.array_join(F.transform(errors, lambda e: F.concat(F.lit("* "), e)), "\n")
    again = F.when(F.size(errors) > 0, F.concat(F.lit("THE LAST DRAFT FAILED; MEND ALL OF THIS\n\n"), listed))
    return F.concat_ws(
        "\n\n", F.lit("EARLIER TURNS"), turns_block(turns), F.lit("MESSAGE"), message, F.lit("PAST EXCHANGES"), evidence_block(found),
        again, F.lit("Write the reply, resting on the past exchanges alone."),
    )


def codebook(kinds: list[dict], title: str) -> str:
    """A section of a system prompt from a specification: name, definition, and include or exclude lists where given."""
    lines = [title]
    for kind in kinds:
        lines.append(f"{kind['name']} = {kind['definition']}")
        lines += [f"  {side}: {' / '.join(kind[side])}" for side in ("include", "exclude") if kind.get(side)]
    return "\n".join(lines)
