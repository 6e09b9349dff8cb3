"""Operator 12: personal data, in DataFrame functions only.

Regular expressions propose spans, validators confirm them, context words adjust their score (whole hundredths).

| kind | proposed by | confirmed by | score: proposed, confirmed, with context |
| - | - | - | - |
| email | local part, `@`, two labels or more | - | 70, -, +20 |
| ip | four runs of digits | every part at most 255 | 30, +30, +20 |
| card | digits, single blanks or hyphens between | 14 to 19 digits, Luhn | 20, +60, +20 |
| phone | `+`, digits, blanks, brackets, dots, hyphens | 10 to 15 digits | 30, +30, +20 |
| iban | two capitals, two digits, groups of four | 15 to 34 signs, mod-97 is 1, no letter or digit beside it | 10, +70, +20 |
| ssn | three, two and four digits with hyphens | no reserved number, no digit or hyphen beside it | 10, +20, +40 |

The first four kinds are the base: what their validators confirm stays, whatever its score. Added to it are ibans, ssns of
at least LEAST points (so only near a context word), and cards inside a run of over 19 digits: one of its blocks without
separators that has 14 to 19 digits and passes Luhn. Any other span that its validator rejects goes; no shorter or later
one is tried in its place. Kinds are searched independently, so spans of different kinds may overlap. Context are up to
BEFORE code points before a span and AFTER behind it, none of them inside another match of its kind. A group of four
capitals that follows an iban in groups of four is taken into it, which then fails its checksum.

Everything happens inside a row: no shuffle, no join. The patterns are written so that no text makes them backtrack: a
run of signs is tried from its start or from the end of the last match only, and repeats are possessive. Offsets are
prefix sums over the pieces between the matches, in blocks, so that a text of a million matches takes no quadratic time.

A null text is an empty one and has no spans; null ids and repeated rows stay as they are, each with its own result; an
empty table gives an empty result; find_pii keeps all columns of its input and returns the spans in a column whose name
the caller chooses; the query ignores other columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covary.llm.shared import let, quoted, table

LEAST, BEFORE, AFTER = 50, 40, 20
SPANS = "array<struct<start:int,kind_order:int,end:int,kind:string,score:int,base:boolean>>"
#: Elements of a block of prefix sums.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    name: str
    #: `pattern` finds, leftmost and without overlap, what `plain` finds, in linear time.
    pattern: str
    plain: str
    hint: str  # what a text must hold for the pattern to fit at all
    words: str
    proposed: int
    confirmed: int
    context: int
    base: bool = True


KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "@", "[Mm][Aa][Ii][Ll]|[Cc]ontact|[Kk]ontakt|[Cc]orreo", 70, 0, 20),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "[0-9]\\.[0-9]", "[Ii][Pp]|[Hh]ost|[Ss]erver|[Aa]ddress|[Aa]dresse", 30, 30, 20),
    Kind("card", r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", "[0-9][\\x20-]?[0-9][\\x20-]?[0-9]", "[Cc]ard|[Vv]isa|[Cc]redit|[Kk]arte|[Cc]arte|[Tt]arjeta", 20, 60, 20),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]", "[Pp]hone|[Tt]el|[Cc]all|[Mm]obil|[Ff]ax", 30, 30, 20),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}(?:[\x20-]?[A-Z0-9]{1,3})?", r"[A-Z]{2}[0-9]{2}(?:[\x20-]?[A-Z0-9]{4}){2,7}(?:[\x20-]?[A-Z0-9]{1,3})?", "[A-Z]{2}[0-9]{2}", "[Ii][Bb][Aa][Nn]|[Aa]ccount|[Bb]ank|[Kk]onto|[Cc]ompte|[Cc]uenta", 10, 70, 20, False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]{2}-[0-9]", "[Ss][Ss][Nn]|[Ss]ocial [Ss]ecurity", 10, 20, 40, False),
]


def running_ends(pieces: Column) -> Column:
    """array<struct<.., size int>> -> the sum of the sizes up to and with each element."""

    def of_blocks(blocks: Column) -> Column:
        total = lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x["size"])
        grown = F.aggregate(F.transform(blocks, total), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        inner = lambda z: F.transform(z["b"], lambda x, i: z["from"] + F.aggregate(F.slice(z["b"], F.lit(1), i + 1), F.lit(0), lambda acc, y: acc + y["size"]))
        return F.flatten(F.transform(F.filter(F.arrays_zip(blocks.alias("b"), grown.alias("from")), lambda z: z["b"].isNotNull()), inner))

    blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))
    return let(pieces, lambda p: let(blocks(p), of_blocks))


def luhn(digits: Column) -> Column:
    """Whether the checksum holds of a string of digits."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.ascii(c) - 48 + F.when(i % 2 == 1, F.ascii(c) - 48 - F.when(c > "4", 9).otherwise(0)).otherwise(0))
    return F.aggregate(at, F.lit(0), lambda acc, x: acc + x) % 10 == 0


def mod97(signs: Column) -> Column:
    """The account number's remainder: first four signs to the end, letters as two digits (A is 10)."""
    moved = F.split(F.concat(F.substring(signs, 5, 1000), F.substring(signs, 1, 4)), "")
    value = lambda c: F.ascii(c) - F.when(c <= "9", 48).otherwise(55)
    return F.aggregate(moved, F.lit(0), lambda acc, c: (acc * F.when(c <= "9", 10).otherwise(100) + value(c)) % 97)


def confirmed(kind: str, x: Column) -> Column:
    """Whether what was proposed is valid; x has text, before and after."""
    m = x["text"]
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"\A0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)){3}\z")
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        signs = F.regexp_replace(m, "[^0-9A-Z]", "")
        return F.length(signs).between(15, 34) & ~x["before"].rlike(r"[A-Za-z0-9]\z") & ~x["after"].rlike(r"\A[A-Za-z0-9]") & (mod97(signs) == 1)
    if kind == "ssn":
        return ~m.rlike(r"\A(?:000|666|9|...-00|......-0000)") & ~x["before"].rlike(r"[0-9-]\z") & ~x["after"].rlike(r"\A[0-9-]")
    return F.lit(True)


def spans_of(text: Column, order: int, kind: Kind) -> Column:
    """The spans of one kind, as SPANS."""
    matches, gaps = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)), F.split(text, kind.pattern, -1)
    # a piece is what lies between two matches and the match behind it; the last has no match
    sized = lambda z: F.struct(z["gap"].alias("gap"), z["text"].alias("text"), (F.char_length(z["gap"]) + F.coalesce(F.char_length(z["text"]), F.lit(0))).alias("size"))
    pieces = F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("text")), sized)

    def found(p: Column) -> Column:
        rest = F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: F.left(x["gap"], F.lit(AFTER)))
        each = F.arrays_zip(p.alias("p"), running_ends(p).alias("end"), rest.alias("after"))
        whole = F.transform(
            F.filter(each, lambda z: z["p"]["text"].isNotNull()),
            lambda z: F.struct((z["end"] - F.char_length(z["p"]["text"])).alias("start"), z["end"].alias("end"), z["p"]["text"].alias("text"), F.right(z["p"]["gap"], F.lit(BEFORE)).alias("before"), z["after"].alias("after")),
        )
        near = lambda x: F.when(x["before"].rlike(kind.words) | x["after"].rlike(kind.words), kind.context).otherwise(0)
        span = lambda start, end, x, base: F.struct(start.alias("start"), F.lit(order).alias("kind_order"), end.alias("end"), F.lit(kind.name).alias("kind"), F.least(F.lit(100), kind.proposed + kind.confirmed + near(x)).alias("score"), F.lit(base).alias("base"))
        scored = lambda w: F.transform(F.filter(w, lambda x: confirmed(kind.name, x)), lambda x: span(x["start"], x["end"], x, kind.base))
        if kind.name == "card":
            return let(whole, lambda w: F.concat(scored(w), F.flatten(F.transform(F.filter(w, lambda x: F.regexp_count(x["text"], F.lit("[0-9]")) > 19), lambda x: blocks_of(x, span)))))
        return scored(whole) if kind.base else F.filter(scored(whole), lambda x: x["score"] >= LEAST)

    def blocks_of(x: Column, span) -> Column:
        """The cards among the blocks of a run of digits that is too long for one."""
        parts = F.transform(F.split(x["text"], "[\\x20-]"), lambda w: F.struct(w.alias("w"), (F.length(w) + 1).alias("size")))
        ended = let(parts, lambda p: F.arrays_zip(p.alias("p"), running_ends(p).alias("end")))
        valid = F.filter(ended, lambda z: F.length(z["p"]["w"]).between(14, 19) & luhn(z["p"]["w"]))
        return F.transform(valid, lambda z: span(x["start"] + z["end"] - z["p"]["size"], x["start"] + z["end"] - 1, x, False))

    return F.when(text.rlike(kind.hint), let(pieces, found)).otherwise(F.array().cast(SPANS))


def find_pii(docs: DataFrame, text_col: str = "text", out: str = "spans") -> DataFrame:
    """docs with `out` added, of type SPANS, by start, then kind; code points, end exclusive."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return docs.select("*", F.sort_array(F.concat(*[spans_of(text, i, k) for i, k in enumerate(KINDS)])).alias(out))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: per document the base kinds' counts and digest, and all spans with their scores."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: (s["kind"] == k.name) & (s["base"] == k.base))).cast("bigint").alias(f"n_{k.name}")
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), scores.alias("scores"))


def _sql() -> str:
    digits, signs = "regexp_replace(m, '[^0-9]', '', 'g')", "regexp_replace(m, '[^0-9A-Z]', '', 'g')"
    at = f"ascii(reverse({digits})[i])"
    luhn_ok = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN ({at} - 48) * 2 - CASE WHEN {at} > 52 THEN 9 ELSE 0 END ELSE {at} - 48 END)) % 10 = 0"
    values = f"list_transform(string_split({signs}[5:] || {signs}[1:4], ''), lambda c: CAST(ascii(c) - CASE WHEN c <= '9' THEN 48 ELSE 55 END AS BIGINT))"
    mod = f"list_reduce(list_prepend(CAST(0 AS BIGINT), {values}), lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97)"
    card = f"length({digits}) BETWEEN 14 AND 19 AND {luhn_ok}"
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0",
        "card": card,
        "phone": f"length({digits}) BETWEEN 10 AND 15",
        "iban": f"length({signs}) BETWEEN 15 AND 34 AND NOT regexp_matches(b, '[A-Za-z0-9]$') AND NOT regexp_matches(f, '^[A-Za-z0-9]') AND {mod} = 1",
        "ssn": "NOT regexp_matches(m, '^(?:000|666|9|...-00|......-0000)') AND NOT regexp_matches(b, '[0-9-]$') AND NOT regexp_matches(f, '^[0-9-]')",
    }
    parts = []
    for n, k in enumerate(KINDS):
        score = f"least(100, {k.proposed + k.confirmed} + CASE WHEN regexp_matches(b, '{k.words}') OR regexp_matches(f, '{k.words}') THEN {k.context} ELSE 0 END) AS score"
        found = f"""(SELECT doc_id, r, ms[i] AS m, right(gs[i], {BEFORE}) AS b, left(gs[i + 1], {AFTER}) AS f, CAST(list_sum(list_transform(gs[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, r, regexp_extract_all(text, '{k.plain}') AS ms, regexp_split_to_array(text, '{k.plain}') AS gs FROM d WHERE regexp_matches(text, '{k.plain}'))))"""
        parts.append(f"SELECT r, {n} AS o, '{k.name}' AS kind, s, s + length(m) AS e, {score}, {k.base} AS base FROM {found} WHERE {ok[k.name]} {'' if k.base else f'AND score >= {LEAST}'}")
        if k.name == "card":
            block = f"""(SELECT r, b, f, ws[i] AS m, s + list_sum(list_transform(ws[1:i], lambda z: length(z) + 1)) - length(ws[i]) - 1 AS s
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT *, regexp_split_to_array(m, '[\\x20-]') AS ws FROM {found} WHERE length({digits}) > 19)))"""
            parts.append(f"SELECT r, {n} AS o, '{k.name}' AS kind, s, s + length(m) AS e, {score}, false AS base FROM {block} WHERE {card}")
    text = lambda only: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o, e) FILTER ({only}), '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), p AS ({' UNION ALL '.join(parts)})
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = '{k.name}' AND base = {k.base}) AS n_{k.name}" for k in KINDS)}, sha256({text('base')}) AS base_sha256, {text('kind IS NOT NULL')} AS spans,
  coalesce(string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, o, e), '') AS scores
FROM d LEFT JOIN p ON d.r = p.r GROUP BY d.r, d.doc_id"""


SQL = _sql()
