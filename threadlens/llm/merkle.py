"""Document fingerprints as Merkle trees over paragraphs and sections, in DataFrame functions only.

A paragraph ends behind a line break. By one rule, whatever its length, a paragraph is cut into leaves by its content: behind
white space that follows a punctuation mark or the letter e, but after LEAF characters at the latest, so that a long
paragraph isn't one leaf and an edit disturbs the leaves that it touches alone. A leaf's hash is of 64 bits; a paragraph's is that
of its leaves' hashes; a run of paragraphs up to one whose hash is a multiple of ``SECTION`` is a section, hashed likewise;
the root is a digest of 128 bits of the sections' hashes.

fingerprint: ``root:section=paragraph,paragraph...;section=...`` in hex: 32 digits of the root, 8 of each section, and for a
paragraph 5 of each of its leaves. Equal roots mean equal texts; sections with different hashes, in them different paragraphs,
and in these different leaves locate edits. Hashes are whole until they are printed, so shortening them can at most make
two different leaves look alike, one in a million pairs. Leaves carry their delimiters, so the tree covers every character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.shared import let, table, written

SECTION = 8
LEAF = 64
#: Hex digits of a leaf and of a section.
LEAF_HEX, SECTION_HEX = 5, 8
#: Most rows, about, whose texts one window task sorts.
RANGE_ROWS = 100_000
_PARAGRAPH = r"[^\n]*\n|[^\n]+"
_CUT = rf"(?s).{{0,{LEAF - 2}}}?(?:\n|[.!?,;:|e] )|.{{1,{LEAF}}}"
_ROOT = 32


def paragraphs(text: Column) -> Column:
    """The text in paragraphs; joined, they are the text. An empty text has one empty paragraph, null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0)))


def leaves(paragraph: Column) -> Column:
    """A paragraph in leaves; an empty one has one empty leaf."""
    return F.when(F.length(paragraph) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(paragraph, F.lit(_CUT), F.lit(0)))


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.bitwiseAND(F.lit((1 << 4 * digits) - 1)) if digits < 16 else value), digits, "0")


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text."""

    def printed(hashes: Column) -> Column:
        """A paragraph: its hash, what is shown of its leaves, and ";" if it ends a section, else ","."""
        shown = F.array_join(F.transform(hashes, lambda h: _hex(h, LEAF_HEX)), "")
        return let(F.xxhash64(hashes), lambda h: F.concat(_hex(h, 16), shown, F.when(F.pmod(h, F.lit(SECTION)) == 0, F.lit(";")).otherwise(F.lit(","))))

    marked = F.transform(F.transform(paragraphs(text), lambda p: F.transform(leaves(p), lambda x: F.xxhash64(x))), printed)
    runs = F.split(F.rtrim(F.array_join(marked, ""), F.lit(",;")), ";")
    parts = F.transform(runs, lambda r: let(F.split(r, ","), lambda ps: F.struct(
        F.xxhash64(F.transform(ps, lambda p: F.substring(p, 1, 16))).alias("h"),
        F.array_join(F.transform(ps, lambda p: F.substring(p, F.lit(17), F.length(p))), ",").alias("s"))))
    shown = lambda sections: F.concat(
        F.substring(F.sha2(F.array_join(F.transform(sections, lambda s: _hex(s["h"], 16)), ""), 256), 1, _ROOT), F.lit(":"),
        F.array_join(F.transform(sections, lambda s: F.concat(_hex(s["h"], SECTION_HEX), F.lit("="), s["s"])), ";"))
    return F.lower(let(parts, shown))


def _leaves_of(print_: Column) -> Column:
    body = F.substring(print_, F.lit(_ROOT + 2), F.length(print_))
    return F.regexp_extract_all(F.regexp_replace(body, f"[0-9a-f]{{{SECTION_HEX}}}=|[,;]", ""), F.lit(f".{{{LEAF_HEX}}}"), F.lit(0))


def likeness(a: Column, b: Column) -> Column:
    """The share of two fingerprints' distinct leaves that both have, 0 to 1; 1 for equal roots."""
    shared = let(
        F.struct(F.array_distinct(_leaves_of(a)).alias("x"), F.array_distinct(_leaves_of(b)).alias("y")),
        lambda p: 2 * F.size(F.array_intersect(p["x"], p["y"])) / (F.size(p["x"]) + F.size(p["y"])),
    )
    return F.when(a == b, F.lit(1.0)).otherwise(shared)


def sections_changed(a: Column, b: Column) -> Column:
    """How many of the first fingerprint's sections the second doesn't have."""
    of = lambda p: F.split(F.substring_index(p, ":", -1), ";")
    return F.when(F.substring(a, 1, _ROOT) == F.substring(b, 1, _ROOT), F.lit(0)).otherwise(F.size(F.array_except(of(a), of(b))))


def differing(a: str, b: str) -> Column:
    """Where the fingerprint in column a differs from that in b: array<struct<section, paragraph, leaves>>, numbers from 0, those
    of paragraphs inside their section and of leaves inside their paragraph.

    Equal roots differ nowhere. Else sections are compared by their hashes; below those that the other tree doesn't have,
    paragraphs that no differing section of the other tree has; and in them the leaves that none of its differing paragraphs
    has. Time grows with the product of the two trees' nodes below differing sections; to count these alone, use
    ``sections_changed``.
    """
    cut = f"regexp_extract_all({{0}}, '.{{{{{LEAF_HEX}}}}}', 0)".format
    within = lambda s: f"split(substring_index({s}, '=', -1), ',')"
    return F.expr(f"""
        if(substring({a}, 1, {_ROOT}) = substring({b}, 1, {_ROOT}), cast(array() as array<struct<section:int,paragraph:int,leaves:array<int>>>),
           transform(array(struct(split(substring_index({a}, ':', -1), ';') as x, split(substring_index({b}, ':', -1), ';') as y)), t ->
           transform(array(flatten(transform(array_except(t.y, t.x), s -> {within("s")}))), ps ->
           transform(array(flatten(transform(ps, p -> {cut("p")}))), known ->
           flatten(transform(filter(transform(t.x, (s, i) -> struct(i as i, s as s)), z -> not array_contains(t.y, z.s)), z ->
               transform(filter(transform({within("z.s")}, (p, k) -> struct(k as k, p as p)), q -> not array_contains(ps, q.p)), q -> struct(
                   z.i as section, q.k as paragraph,
                   filter(transform({cut("q.p")}, (leaf, n) -> if(array_contains(known, leaf), null, n)), n -> n is not null) as leaves
               ))))
           )[0])[0])[0])
    """)


def _bounds(keys: DataFrame) -> DataFrame:
    """One row: the greatest key k of each range, in order; the last is that of all. Ranges have at most RANGE_ROWS rows, or
    fewer, so that there are two for each shuffle partition."""
    placed = written(keys.repartitionByRange("k").withColumn("part", F.spark_partition_id()), "id-ranges")
    tasks = 2 * int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, min(RANGE_ROWS, -(-placed.count() // tasks)))
    place = F.row_number().over(W.partitionBy("part").orderBy("k"))
    inner = placed.withColumn("place", place).filter(F.pmod("place", F.lit(rows)) == 0).select("k")
    ends = placed.groupBy("part").agg(F.max("k").alias("k")).select("k")
    return written(inner.unionByName(ends).distinct().agg(F.array_sort(F.collect_list("k")).alias("bounds")), "bounds")


def _range_of(key: str, bounds: str) -> Column:
    """The number of the first bound that isn't below the key, by halving."""
    return F.expr(f"""
        aggregate(sequence(1, 1 + cast(ceil(log2(size({bounds}) + 1)) as int)), struct(0 as lo, size({bounds}) - 1 as hi),
            (s, i) -> if(s.lo >= s.hi, s, if({bounds}[(s.lo + s.hi) div 2] >= {key},
                struct(s.lo as lo, cast((s.lo + s.hi) div 2 as int) as hi), struct(cast((s.lo + s.hi) div 2 + 1 as int) as lo, s.hi as hi))),
            s -> s.lo)
    """)


def with_next(documents: DataFrame) -> DataFrame:
    """doc_id, text, next_text of each row: the next row by descending doc_id, null ids last, repeated ids by a hash of the text; the last row's next is the first.

    doc_id is of any type that has an order. A pass over ids alone finds the bounds of ranges of at most about RANGE_ROWS rows,
    however the ids are spread; the bounds go to all tasks as one value, an id and a hash for each range. Each range's
    greatest row goes to the range above as well, so that each range finds all successors among its own rows: texts are
    shuffled once, and no window spans all rows. Rows equal in id and text share a range. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("hash"))
    rows = documents.select("doc_id", text.alias("text"), key.alias("k"))
    bounds = _bounds(rows.select("k"))
    rows = rows.withColumn("bounds", bounds.scalar())
    rows = rows.withColumn("range", _range_of("k", "bounds"))
    own = F.struct(F.col("range").alias("range"), F.lit(1).alias("own"))
    above = F.struct(((F.col("range") + 1) % F.size("bounds")).alias("range"), F.lit(0).alias("own"))
    places = F.when(F.get("bounds", F.col("range")) == F.col("k"), F.array(own, above)).otherwise(F.array(own))
    rows = rows.select("doc_id", "text", "k", F.explode(places).alias("p"))
    w = W.partitionBy("p.range").orderBy("p.own", "k")
    rows = rows.withColumn("next_text", F.lag("text").over(w))
    return rows.filter("p.own = 1").select("doc_id", "text", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """The text with its last third (code points, rounded down) replaced by the first as many of the next one."""
    n = F.length(text)
    third = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - third), F.substring(next_text, F.lit(1), third))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # prints are made behind the shuffle, which they would double
    rows = with_next(table(spark, sf_dir, "documents")).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        fingerprint(F.col("next_text")).alias("next_fingerprint"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        sections_changed(F.col("fingerprint"), F.col("edited_fingerprint")).alias("sections_changed"),
    )
