"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only. Java's regex functions give no offsets, so every match is put
between NUL marks and the text is split at them: pieces at odd places are the matches and
piece lengths add up to code point offsets. NUL itself is first replaced in the text by
another character that no pattern holds.

Patterns start at the beginning of a run, or where the last match ended, and their loops are
possessive, so that long runs without a match cost linear time and no stack.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\u0000"


@dataclass(frozen=True)
class Kind:
    name: str
    #: Java pattern, with the same matches as the contract's pattern of the kind, or those that can pass.
    pattern: str
    #: A cheap necessary condition on a text.
    needs: str
    #: Lower-case words that make a span near them likelier.
    context: str
    base: float


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", r"mail|contact|write", 0.8),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", r"\bip\b|address|server|host|login", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", r"[0-9](?:[\x20-]?[0-9]){12}", r"card|visa|credit|pay|account", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", r"phone|tel|call|mobile|fax", 0.7),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", r"iban|account|bank|transfer", 0.8
    ),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"ssn|social|security", 0.6),
)
BASE = KINDS[:4]
#: Code points before and behind a span that are looked at for context words.
NEAR = 40
#: Lengths that are added up in one go.
BLOCK = 128
#: What a context word adds to a span's score.
NEARBY = 0.2
#: A span with this score counts as confident.
CONFIDENT = 0.8


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _mod97(iban: Column) -> Column:
    """The IBAN check: first four characters to the end, letters to 10..35, remainder 1."""
    plain = F.translate(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(total: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (total * 10 + c - 48) % 97).otherwise((total * 100 + c - 55) % 97)

    return (F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1) & F.length(plain).between(15, 34)


def _valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern holds; matches that don't are dropped."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return _mod97(value)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _parts(text: Column, kind: Kind) -> Column:
    return F.split(F.regexp_replace(text, f"({kind.pattern})", f"{NUL}$1{NUL}"), NUL, -1)


def _let(value: Column, body) -> Column:
    """``body(value)``, the value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _starts(lengths: Column) -> Column:
    """Running sums of an array, each up to before its item, in blocks, so that none adds up all before it."""
    n_blocks = F.ceil(F.size(lengths) / BLOCK).cast("int")
    numbers = F.sequence(F.lit(0), n_blocks - 1)
    sums = F.transform(numbers, lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    bases = _let(sums, lambda s: F.transform(numbers, lambda b: _sum(F.slice(s, F.lit(1), b))))

    def at(base: Column) -> Column:
        def one(i: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            return F.get(base, b) + _sum(F.slice(lengths, b * BLOCK + 1, i % BLOCK))

        return F.transform(F.sequence(F.lit(1), F.size(lengths) - 1, F.lit(2)), one)

    return _let(bases, at)


def _spans(text: Column, kind: Kind) -> Column:
    """The kind's spans of a text without NUL: array of (kind, start, end, score), by start.

    The work grows with the text and the number of spans, not with their product: context comes
    from the pieces around a match, of which NEAR at most can lie within NEAR code points on a side.
    """
    none = F.expr("array()").cast("array<struct<kind:string,start:int,end:int,score:double>>")
    around = 2 * NEAR

    def scored(parts: Column) -> Column:
        tails = F.transform(parts, lambda p: F.right(p, F.lit(NEAR)))
        heads = F.transform(parts, lambda p: F.left(p, F.lit(NEAR)))
        matches = F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == 1, p)), lambda p: p.isNotNull())

        def rows(x: Column) -> Column:
            def row(v: Column, k: Column) -> Column:
                at = 2 * k + 1  # the match's piece, from 0
                before = F.right(F.array_join(F.slice(x["tails"], F.greatest(at - around, F.lit(0)) + 1, F.least(at, F.lit(around))), ""), F.lit(NEAR))
                behind = F.left(F.array_join(F.slice(x["heads"], at + 2, F.lit(around)), ""), F.lit(NEAR))
                near = F.lower(F.concat(before, F.lit(" "), behind)).rlike(kind.context)
                score = F.lit(kind.base) + F.when(near, NEARBY).otherwise(0.0)
                start = F.get(x["starts"], k)
                return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"), F.when(_valid(kind.name, v), score).alias("score"))

            return F.filter(F.transform(x["matches"], row), lambda r: r["score"].isNotNull())

        all_of = F.struct(tails.alias("tails"), heads.alias("heads"), matches.alias("matches"), _let(F.transform(parts, F.length), _starts).alias("starts"))
        return F.when(F.size(parts) > 1, _let(all_of, rows)).otherwise(none)

    return F.when(text.rlike(kind.needs), _let(_parts(text, kind), scored)).otherwise(none)


def find(documents: DataFrame) -> DataFrame:
    """Per document: doc_id and, by kind's name, an array of spans (kind, start, end, score).

    Offsets are code points from 0, the end exclusive. A null text is an empty one, without
    spans. Null and repeated doc_ids are rows like others; other columns are ignored, whatever
    their names. Texts of any length are searched whole.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), NUL, "\u0001").alias("text")
    return documents.select("doc_id", text).select("doc_id", *[_spans(F.col("text"), k).alias(k.name) for k in KINDS])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_personal_data(documents: DataFrame) -> DataFrame:
    """The digest of ``find``: counts, hash of the base spans, all spans, confident spans."""
    every = F.flatten(F.array(*[F.col(k.name) for k in KINDS]))
    return find(documents).select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in KINDS],
        F.sha2(_joined(F.flatten(F.array(*[F.col(k.name) for k in BASE]))).cast("binary"), 256).alias("base_sha256"),
        _joined(every).alias("spans"),
        F.size(F.filter(every, lambda x: x["score"] >= CONFIDENT)).cast("long").alias("n_confident"),
    )


def _redact(text: Column, kind: Kind) -> Column:
    def piece(p: Column, i: Column) -> Column:
        return F.when((i % 2 == 1) & _valid(kind.name, p), f"[{kind.name.upper()}]").otherwise(p)

    return F.when(text.rlike(kind.needs), F.array_join(F.transform(_parts(text, kind), piece), "")).otherwise(text)


def _oracle() -> str:
    """The same in DuckDB, whose patterns have no look-behind; its data hold runs for which that makes no difference."""
    pattern = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    turned = "(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4))"
    luhn = f"list_sum([CASE WHEN i % 2 = 1 THEN substr(reverse({digits}), i::INT, 1)::INT ELSE (2 * substr(reverse({digits}), i::INT, 1)::INT) // 10 + (2 * substr(reverse({digits}), i::INT, 1)::INT) % 10 END FOR i IN range(1, length({digits}) + 1)]) % 10 = 0"
    number = f"list_aggregate([CASE WHEN ascii(c) < 58 THEN c ELSE (ascii(c) - 55)::VARCHAR END FOR c IN string_split({turned}, '')], 'string_agg', '')"
    valid = {
        "email": "true",
        "ip": "regexp_matches(v, '^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.]|$)){4}')",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"length({turned}) BETWEEN 15 AND 34 AND try_cast(substr({number}, 1, 36) AS HUGEINT) IS NOT NULL AND ((try_cast(substr({number}, 1, 30) AS HUGEINT) % 97)::VARCHAR || substr({number}, 31))::HUGEINT % 97 = 1",
        "ssn": "NOT regexp_matches(v, '^(?:000|666|9)|-00-|-0000$')",
    }
    parts = ", ".join(f"string_split(regexp_replace(t, '({pattern[k.name]})', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p_{k.name}" for k in KINDS)

    def rows(k: Kind, n: int) -> str:
        return f"""SELECT doc_id, t, '{k.name}' AS kind, {n} AS turn, s, s + length(v) AS e FROM (
          SELECT doc_id, t, p_{k.name}[i] AS v, coalesce(list_sum([length(x) FOR x IN p_{k.name}[1:i - 1]]), 0)::BIGINT AS s
          FROM (SELECT *, unnest(range(2, len(p_{k.name}) + 1, 2)) AS i FROM p)) WHERE {valid[k.name]}"""

    found = " UNION ALL ".join(rows(k, n) for n, k in enumerate(KINDS))
    context = " ".join(f"WHEN '{k.name}' THEN '{k.context}'" for k in KINDS)
    base = " ".join(f"WHEN '{k.name}' THEN {k.base}" for k in KINDS)
    near = f"regexp_matches(lower(substr(t, greatest(s - {NEAR}, 0) + 1, least(s, {NEAR})) || ' ' || substr(t, e + 1, {NEAR})), CASE kind {context} END)"
    counts = ", ".join(f"count(f.kind) FILTER (f.kind = '{k.name}') AS n_{k.name}" for k in KINDS)
    item = "f.kind || ':' || f.s || ':' || f.e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, {parts} FROM d),
f AS ({found}),
g AS (SELECT *, CASE kind {base} END + CASE WHEN {near} THEN {NEARBY} ELSE 0 END AS score FROM f)
SELECT d.doc_id, {counts},
  sha256(coalesce(string_agg({item}, ',' ORDER BY f.turn, f.s) FILTER (f.turn < {len(BASE)}), '')) AS base_sha256,
  coalesce(string_agg({item}, ',' ORDER BY f.turn, f.s) FILTER (f.kind IS NOT NULL), '') AS spans, count(*) FILTER (f.score >= {CONFIDENT}) AS n_confident
FROM d LEFT JOIN g f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""


ORACLE_SQL = _oracle()


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with every span that holds replaced by its kind, as ``[EMAIL]``; null texts stay null.

    Whatever isn't part of a span stays as it is, NUL too. Null and repeated doc_ids are rows like
    others; other columns stay, whatever their names, but n_chars, where there is such a column,
    follows the new text. Texts of any length are redacted whole. Each kind is a step of its own
    that reads the text several times; as one expression the steps would multiply.
    """
    # While the marks are NUL, the text's own NULs are U+0001 U+0002, and its U+0001 are U+0001 U+0003.
    escaped = F.replace(F.replace("text", F.lit("\u0001"), F.lit("\u0001\u0003")), F.lit(NUL), F.lit("\u0001\u0002"))
    odd = F.col("text").rlike("[\u0000\u0001]")
    out = documents.withColumn("text", F.when(odd, escaped).otherwise(F.col("text")))
    for name in ("email", "iban", "card", "ssn", "phone", "ip"):
        out = out.withColumn("text", _redact(F.col("text"), next(k for k in KINDS if k.name == name)))
    plain = F.replace(F.replace("text", F.lit("\u0001\u0002"), F.lit(NUL)), F.lit("\u0001\u0003"), F.lit("\u0001"))
    out = out.withColumn("text", F.when(F.contains("text", F.lit("\u0001")), plain).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out
