"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans: the four base kinds by their fixed patterns, and further kinds (numbers in
groups, secrets, bank accounts, spelled-out mail addresses) that often are something else. Boosted trees score the further
candidates from features of their format and of the text around them; a candidate is redacted if it reaches its kind's
threshold. They are looked for in what base spans leave of a text. Base spans always stay.

The trees are fitted on TRAINING_ROWS synthetic sentences, made by a rule from templates of both labels in which digits
and letters vary; thresholds are calibrated on templates that were held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import boosting
from threadlens.llm.shared import fresh, own_columns, table

TRAINING_ROWS = 4000
FOLDS = 5
PRECISION = 0.99
AROUND = 24
#: Spans that are placed, or pieces of text that are cut, one by one; more go by blocks of as many.
BLOCK = 256

# The base kinds in the order in which they are listed, as patterns. A quantifier that nothing can
# follow otherwise is possessive, which Java's engine runs in a loop where it would recurse. An address's name starts where
# its run of characters does, or behind the match before (``\G``), so that a long run is read once; a card's digits are 13 at least.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: SQL: texts that can't have a valid match skip the pattern.
MAY_HAVE = {
    "email": "contains({}, '@')",
    "ip": r"{} rlike r'[0-9]\.[0-9]++\.[0-9]++\.[0-9]'",
    "card": r"{} rlike r'[0-9](?:[\x20-]?+[0-9]){{12}}'",
    "phone": "contains({}, '+')",
}
MORE = {
    "number": r"\(?[0-9]{2,4}\)?(?:[ ./-]\(?[0-9]{2,4}\)?){2,4}",
    "secret": r"(?:AKIA|ghp_|sk_)[0-9A-Za-z_]{12,}+|(?i:password|passwd|token|secret|api_key)[ ]?[=:][ ]?\"?[^\s\"]{6,}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?",
    "email_at": r"[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?:(?: ?[\[(] ?dot ?[\])] ?| dot |\.)[A-Za-z0-9-]++)++",
}
MORE_MAY_HAVE = {
    "number": r"{} rlike r'[0-9]\)?[ ./-]\(?[0-9]{{2,4}}\)?[ ./-]\(?[0-9]{{2}}'",
    "secret": r"{} rlike r'AKIA|ghp_|sk_|(?i:password|passwd|token|secret|api_key)[ ]?[=:]'",
    "iban": r"{} rlike r'[A-Z]{{2}}[0-9]{{2}} ?[0-9A-Z]{{4}} ?[0-9A-Z]{{4}}'",
    "email_at": r"{} rlike r'[\[(] ?at ?[\])]'",
}
CUES = r"(?i)(phone|tel|call|fax|mobile|ssn|social|iban|account|konto|mail|contact|write)[a-z]{0,5}[ :.#]{0,3}$"
FEATURES = [
    "number", "digits", "letters", "separators", "length", "groups", "last_group", "first_group", "distinct",
    "cue", "glued_before", "glued_after", "dots", "slashes", "quoted", "mixed",
]


_SPAN = "struct<kind:string,start:int,end:int,found:string,before:string,after:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: the body with the value under a name, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _blocks(items: str) -> str:
    """SQL: the items, of which there is one at least, in arrays of BLOCK."""
    return f"transform(sequence(0, (size({items}) - 1) div {BLOCK}), k -> slice({items}, cast(k * {BLOCK} + 1 as int), {BLOCK}))"


def spans(text: str, pattern: str, kind: str) -> str:
    """SQL: array<struct<kind, start, end, found, before, after>> of all matches in a text, in code points, end exclusive.

    Matches lie between the pieces that the pattern splits the text into; before and after are text around them, as far
    as the matches on either side. Places are summed up inside blocks of matches, then over blocks.
    """
    pairs = (
        "transform(x.m, (m, i) -> named_struct('p', x.p[i], 'm', m, 'q', x.p[i + 1], "
        "'b', if(i = 0, '', x.m[greatest(i - 1, 0)]), 'a', if(i + 1 < size(x.m), x.m[least(i + 1, size(x.m) - 1)], '')))"
    )

    def placed(block: str) -> str:
        one = (
            f"named_struct('kind', '{kind}', 'start', acc.pos + length(y.p), 'end', acc.pos + length(y.p) + length(y.m), "
            f"'found', y.m, 'before', right(concat(y.b, y.p), {AROUND}), 'after', left(concat(y.q, y.a), 1))"
        )
        return (
            f"aggregate({block}, named_struct('pos', 0, 'items', {_NONE}), (acc, y) -> named_struct("
            f"'pos', acc.pos + length(y.p) + length(y.m), 'items', concat(acc.items, array({one}))))"
        )

    starts = (
        "aggregate(parts, named_struct('pos', 0, 'items', cast(array() as array<int>)), (acc, y) -> "
        "named_struct('pos', acc.pos + y.pos, 'items', concat(acc.items, array(acc.pos))), acc -> acc.items)"
    )
    moved = "named_struct('kind', z.kind, 'start', z.start + n, 'end', z.end + n, 'found', z.found, 'before', z.before, 'after', z.after)"
    joined = _let(starts, "starts", f"flatten(zip_with(parts, starts, (part, n) -> transform(part.items, z -> {moved})))")
    many = _let(pairs, "pairs", _let(f"transform({_blocks('pairs')}, block -> {placed('block')})", "parts", joined))
    both = f"named_struct('p', split({text}, r'{pattern}', -1), 'm', regexp_extract_all({text}, r'{pattern}', 0))"
    return _let(both, "x", f"case when size(x.m) = 0 then {_NONE} when size(x.m) <= {BLOCK} then {placed(pairs)}.items else {many} end")


_DIGITS = "regexp_replace(y.found, '[^0-9]', '')"
_LUHN = (
    "aggregate(sequence(1, length(d)), 0, (total, i) -> total + case when i % 2 = 1 then int(substring(reverse(d), i, 1)) "
    "when substring(reverse(d), i, 1) > '4' then 2 * int(substring(reverse(d), i, 1)) - 9 "
    "else 2 * int(substring(reverse(d), i, 1)) end) % 10 = 0"
)
#: SQL on a match y: whether it counts.
_VALID = {
    "email": "true",
    "ip": "forall(split(y.found, '[.]'), q -> length(trim(leading '0' from q)) < 4 and int('0' || right(q, 3)) <= 255)",
    "card": _let(_DIGITS, "d", f"case when length(d) between 13 and 19 then {_LUHN} else false end"),
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def _swept(ordered: str, item: str, both: str) -> str:
    """SQL: spans in order of their starts, with ``both`` (SQL on run.last and x) in place of two that overlap. Spans are
    appended inside blocks, and blocks to the result, so that no step copies all of it for one span."""
    state = f"named_struct('items', cast(array() as array<{item}>), 'last', {{}})"
    inner = (
        f"aggregate(block, {state.format('acc.last')}, (run, x) -> named_struct("
        "'items', case when run.last.end <= x.start then concat(run.items, array(run.last)) else run.items end, "
        f"'last', case when run.last is null or run.last.end <= x.start then x else {both} end))"
    )
    step = _let(inner, "part", "named_struct('items', concat(acc.items, part.items), 'last', part.last)")
    return _let(
        ordered,
        "ordered",
        f"aggregate({_blocks('ordered')}, {state.format(f'cast(null as {item})')}, (acc, block) -> {step}, "
        "acc -> case when acc.last is null then acc.items else concat(acc.items, array(acc.last)) end)",
    )


def _base_sql(text: str) -> str:
    of = (f"case when {MAY_HAVE[k].format(text)} then filter({spans(text, BASE[k], k)}, y -> {_VALID[k]}) else {_NONE} end" for k in BASE)
    return f"concat({', '.join(of)})"


def base_spans(text: str) -> Column:
    """The spans of the base kinds in a string column, by kind as listed and then start."""
    return F.expr(f"transform({_base_sql(text)}, y -> {_plain('y')})")


def _plain(x: str) -> str:
    return f"named_struct('kind', {x}.kind, 'start', {x}.start, 'end', {x}.end, 'found', {x}.found)"


def candidates(text: str) -> str:
    """SQL: the spans of the further kinds, not yet judged."""
    of = (f"case when {MORE_MAY_HAVE[k].format('t')} then {spans('t', p, k)} else {_NONE} end" for k, p in MORE.items())
    return _let(text, "t", f"concat({', '.join(of)})")


def _featured(found: str) -> str:
    """SQL: spans with a field for each feature."""
    number = " ".join(f"when '{k}' then {i}" for i, k in enumerate(MORE))
    values = {
        "number": f"case c.kind {number} end",
        "digits": "regexp_count(c.found, '[0-9]')",
        "letters": "regexp_count(c.found, '[A-Za-z]')",
        "separators": "regexp_count(c.found, '[ ./()-]')",
        "length": "length(c.found)",
        "groups": "size(g)",
        "last_group": "length(g[size(g) - 1])",
        "first_group": "length(g[0])",
        "distinct": "size(array_distinct(split(regexp_replace(c.found, '[^0-9]', ''), '')))",
        "cue": f"int(c.before rlike r'{CUES}')",
        "glued_before": "int(c.before rlike '[0-9A-Za-z.,/=$€£#-]$')",
        "glued_after": "int(c.after rlike '[0-9A-Za-z/%$€£-]')",
        "dots": "regexp_count(c.found, '[.]')",
        "slashes": "regexp_count(c.found, '/')",
        "quoted": "regexp_count(c.found, '\"')",
        "mixed": "int(g[size(g) - 1] rlike '[0-9]' and g[size(g) - 1] rlike '[A-Za-z]')",
    }
    fields = ", ".join(f"'{f}', double({values[f]})" for f in FEATURES)
    groups = "split(regexp_replace(c.found, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', ''), '[^0-9A-Za-z]+')"
    one = _let(groups, "g", f"named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'found', c.found, {fields})")
    return f"transform({found}, c -> {one})"


@dataclass
class Model:
    trees: list[boosting.Node]
    thresholds: dict[str, float]


# Templates of the training sentences: kind, label, SQL. d(n): n digits; h(n): n hex; u(n): n capitals or digits; w: a word.
_TEMPLATES = [
    (1, "concat('(', d(3), ') ', d(3), '-', d(4))"),
    (1, "concat(d(3), '-', d(3), '-', d(4))"),
    (1, "concat('call ', d(3), ' ', d(3), ' ', d(4))"),
    (1, "concat('phone: ', d(4), ' ', d(3), ' ', d(4))"),
    (1, "concat(d(3), '.', d(3), '.', d(4))"),
    (1, "concat('ssn ', d(3), '-', d(2), '-', d(4))"),
    (1, "concat(d(3), '-', d(2), '-', d(4))"),
    (1, "concat('password=', h(18))"),
    (1, "concat('token = \"', h(40), '\"')"),
    (1, "concat('api_key: ', h(24))"),
    (1, "concat('AKIA', u(16))"),
    (1, "concat('DE', d(2), ' ', d(4), ' ', d(4), ' ', d(4), ' ', d(4), ' ', d(2))"),
    (1, "concat('iban FR', d(2), d(4), d(4), d(4), d(4), d(4), d(3))"),
    (1, "concat(w, '.', w, ' [at] ', w, ' [dot] com')"),
    (1, "concat('mail ', w, ' (at) ', w, '.org')"),
    (0, "concat('20', d(2), '-', d(2), '-', d(2))"),
    (0, "concat(d(2), '.', d(2), '.20', d(2))"),
    (0, "concat(d(2), '/', d(2), '/', d(4))"),
    (0, "concat('version ', d(2), '.', d(2), '.', d(3))"),
    (0, "concat('items ', d(2), ' ', d(2), ' ', d(2), ' ', d(2))"),
    (0, "concat('$', d(3), ' ', d(3), ' ', d(3))"),
    (0, "concat('page-', d(3), '-', d(3), '-', d(3), '-', d(2))"),
    (0, "concat('isbn ', d(3), '-', d(2), '-', d(4), '-', d(3))"),
    (0, "concat('password: ', w, w)"),
    (0, "concat('token = ', w, w)"),
    (0, "concat('secret: ', w, w, ',')"),
    (0, "concat('AB', d(2), ' ABCD EFGH ', 'WXYZ KLMN')"),
    (0, "concat('XQ', d(2), 'ABCDEFGHIJKLMNOP')"),
    (0, "concat(w, ' (at) ', w, '.', w, w)"),
    (0, "concat('scores ', d(3), '/', d(3), '/', d(3), '/', d(3))"),
]


def training_rows(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """id, label, text: a template between words, its digits and letters by a hash of the row's number."""
    hashed = "sha2(concat_ws(':', id, {n}), 512)"
    word = "translate(substring(sha2(concat_ws(':', id, {n}), 256), 1, 3 + cast(id % 5 as int)), '0123456789', 'ghiklmnopr')"
    cases = []
    for i, (_, sql) in enumerate(_TEMPLATES):
        seed, out, at = i * 100, "", 0
        while at < len(sql):
            if sql[at : at + 2] in ("d(", "h(", "u(") and not sql[at - 1].isalnum():
                n, seed = sql[at + 2 : sql.index(")", at)], seed + 1
                source = hashed.format(n=seed)
                digits = f"regexp_replace({source}, '[a-f]', '')"
                out += {
                    "d": f"substring({digits}, 1, {n})",
                    "h": f"substring({source}, 1, {n})",
                    "u": f"substring(upper(translate({source}, '01', 'QZ')), 1, {n})",
                }[sql[at]]
                at = sql.index(")", at) + 1
            elif sql[at] == "w" and not sql[at - 1].isalnum() and not sql[at + 1].isalnum():
                seed += 1
                out, at = out + word.format(n=seed), at + 1
            else:
                out, at = out + sql[at], at + 1
        cases.append(f"when {i} then {out}")
    n = len(_TEMPLATES)
    label = F.element_at(F.array(*(F.lit(k) for k, _ in _TEMPLATES)), (F.col("id") % n + 1).cast("int"))
    text = f"concat({word.format(n=7)}, ' ', {word.format(n=8)}, ' ', case id % {n} {' '.join(cases)} end, ' ', {word.format(n=9)})"
    return spark.range(rows).select("id", label.alias("label"), F.expr(text).alias("text"))


def fit(spark: SparkSession, rows: int = TRAINING_ROWS) -> Model:
    """Fit on ``rows`` synthetic sentences. Thresholds are calibrated on templates that the trees that judge them
    haven't seen: each fifth of the templates is scored by trees fitted on the rest, and a kind's threshold is the
    least log odds from which on PRECISION of its candidates are personal data. The trees returned are fitted on all."""
    found = training_rows(spark, rows)
    found = found.select("id", "label", F.explode(F.expr(_featured(candidates("text")))).alias("c"))
    got = found.select("id", "label", "c.kind", *(f"c.{f}" for f in FEATURES)).collect()
    got.sort(key=lambda r: (r.id, r.kind, *(r[f] for f in FEATURES)))
    x = np.array([[r[f] for f in FEATURES] for r in got])
    y = np.array([r.label for r in got], float)
    fold = np.array([r.id % len(_TEMPLATES) % FOLDS for r in got])
    names = np.array([r.kind for r in got])
    odds = np.zeros(len(y))
    for k in range(FOLDS):
        odds[fold == k] = boosting.predict(boosting.fit(x[fold != k], y[fold != k]), x[fold == k])
    thresholds = {}
    for kind in MORE:
        part = names == kind
        order = np.argsort(-odds[part], kind="stable")
        score, right = odds[part][order], y[part][order]
        last = np.append(score[1:] != score[:-1], True)  # of equal odds all or none
        precise = last & (np.cumsum(right) >= PRECISION * np.arange(1, len(right) + 1))
        if not precise.any():
            thresholds[kind] = float("inf")
            continue
        least = score[np.flatnonzero(precise)[-1]]
        below = score[score < least]  # midway to the next lower odds, at most 1 down
        thresholds[kind] = float(least - min(1.0, (least - below.max()) / 2) if len(below) else least - 1.0)
    return Model(boosting.fit(x, y), thresholds)


def _added_sql(text: str, base: str, model: Model) -> str:
    """SQL: the spans of the further kinds that reach their thresholds, in the text with line breaks in place of the base spans:
    no further kind has any, so none overlaps them. Of overlapping spans that with higher odds stays; of equals the earlier,
    then the first kind."""
    masked = replaced(text, base, "repeat('\\n', s.end - s.start)")
    odds = boosting.expression(model.trees, [f"c.{f}" for f in FEATURES])
    judged = f"named_struct('start', c.start, 'number', c.number, 'end', c.end, 'kind', c.kind, 'found', c.found, 'odds', {odds})"
    enough = " ".join(f"when '{k}' then c.odds >= double('{t}')" for k, t in model.thresholds.items())
    item = "struct<start:int,number:double,end:int,kind:string,found:string,odds:double>"
    chosen = f"array_sort(filter(transform({_featured(candidates(masked))}, c -> {judged}), c -> case c.kind {enough} end))"
    better = "if(x.odds > run.last.odds, x, run.last)"
    return f"transform({_swept(chosen, item, better)}, c -> {_plain('c')})"


def with_spans(documents: DataFrame, model: Model | None = None, into: str = "personal_data") -> DataFrame:
    """The documents and one more column: struct<base, added>, arrays of struct<kind, start, end, found> of whole texts.

    Offsets are code points, end exclusive. Null and empty texts have no spans. Rows and columns stay as they are,
    repeated rows too; a column that is called ``into`` already is an error. Time and memory grow with a text's length, also
    for texts of one long run of digits, labels or letters, or of very many matches.
    """
    if into.lower() in (c.lower() for c in documents.columns):
        raise ValueError(f"there is a column {into} already")
    model = fit(documents.sparkSession) if model is None else model
    text, base = fresh("text_", documents), fresh("base", documents)
    rows = documents.select("*", F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    rows = rows.select("*", base_spans(text).alias(base))
    both = F.struct(F.col(base).alias("base"), F.expr(_added_sql(text, base, model)).alias("added"))
    return rows.select(*own_columns(documents), both.alias(into))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def replaced(text: str, found: str, by: str) -> str:
    """SQL: the text with ``by`` (SQL on the span s) in place of each span; spans that overlap become one, named by the first."""
    item = "struct<start:int,end:int,kind:string>"
    ordered = f"array_sort(transform({found}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind)))"
    wide = "named_struct('start', run.last.start, 'end', greatest(run.last.end, x.end), 'kind', run.last.kind)"
    # blocks of spans with the text from the block before on, cut once; inside it, each span with the piece before it
    starts = "concat(array(0), transform(blocks, b -> b[size(b) - 1].end))"
    inside = (
        "array_join(transform(block, (s, i) -> concat(substring(part, if(i = 0, 0, block[greatest(i - 1, 0)].end - start) + 1, "
        f"s.start - if(i = 0, start, block[greatest(i - 1, 0)].end)), {by})), '')"
    )
    inside = _let(f"substring({text}, start + 1, block[size(block) - 1].end - start)", "part", inside)
    rest = f"substring({text}, {starts}[size(blocks)] + 1)"
    joined = f"array_join(zip_with(blocks, slice({starts}, 1, size(blocks)), (block, start) -> {inside}), '')"
    return f"case when size({found}) = 0 then {text} else {_let(_swept(ordered, item, wide), 'merged', _let(_blocks('merged'), 'blocks', f'concat({joined}, {rest})'))} end"


def redacted(text: str, found: str) -> Column:
    """A string column with each span of another column replaced by its kind in brackets."""
    return F.expr(replaced(text, found, "concat('[', upper(s.kind), ']')"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, added = F.col("personal_data.base"), F.col("personal_data.added")
    number = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *(number(k) for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, added)).alias("spans"),
        F.size(added).cast("long").alias("n_added"),
    )
