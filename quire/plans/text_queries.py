"""Queries on texts: scalar functions, chunks, and the survival of a text in a damaged copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import fidelity, links
from quire.plans import validate
from quire.runtime import spread
from quire.sources import epub


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.damaged(_docs(spark, sf_dir))


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what the tables lack: ligatures, soft hyphens, words broken at line ends, dashes, numbered points."""
    return _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("ﬁne æon so­ft inter-  \n  national "), "text", F.lit(" first- and third-person , a — b 12. last")).alias("text"))


def normalize_whitespace(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", fn.normalize_whitespace(F.col("text")).alias("text"))


def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.escape_html(F.col("html")).alias("escaped"))


def ligatures_dehyphenate(spark, sf_dir):
    return _seeded(spark, sf_dir).select("doc_id", fn.remove_hyphenation(fn.resolve_ligatures(F.col("text"))).alias("text"))


def comparison_form(spark, sf_dir):
    return _seeded(spark, sf_dir).select("doc_id", fn.comparison_form(F.col("text")).alias("text"))


def canonicalize_nfkc(spark, sf_dir):
    return fn.canonicalize(_seeded(spark, sf_dir), "text", aggressive=True)


def token_extract(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(fn.tokens(F.col("text"))).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


def doc_stats(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", fn.word_count(t).cast("long").alias("n_words"), F.length(t).cast("long").alias("n_chars"), fn.snippet(t).alias("snippet"))


def html_text(spark, sf_dir):
    return epub.with_text(table(spark, sf_dir, "pages").select("page_id", "html"))


def media_types(spark, sf_dir):
    """File names and media types by the kind of event, as images would have them."""
    kind = F.element_at(F.array(*map(F.lit, ("png", "JPEG", "gif", "tiff"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("format"), F.concat(F.lit("scan."), "event_type", F.lit(".bmp")).alias("name"))
    return rows.select("event_id", fn.media_type(F.col("format")).alias("media_type"), fn.rename_extension(F.col("name"), F.col("format")).alias("filename"))


def segment_chunks(spark, sf_dir):
    return fidelity.segment(_docs(spark, sf_dir))


def chunk_contains(spark, sf_dir):
    return links.contained(table(spark, sf_dir, "benchmark"), _docs(spark, sf_dir))


def fidelity_score(spark, sf_dir):
    return fidelity.exact_scores(_pairs(spark, sf_dir))


def fuzzy_find(spark, sf_dir):
    return fidelity.match_table(_pairs(spark, sf_dir)).select("doc_id", F.inline("found")).select("doc_id", "chunk.chunk_no", "pos", "kind")


def completeness_score(spark, sf_dir):
    return fidelity.scores(_pairs(spark, sf_dir))


def missing_chunks(spark, sf_dir):
    return fidelity.missing(_pairs(spark, sf_dir)).drop("snippet")


def reconcile_tokens(spark, sf_dir):
    return fidelity.reconcile(_pairs(spark, sf_dir))


def fidelity_report(spark, sf_dir):
    return fidelity.report(_pairs(spark, sf_dir))


def order_score_lis(spark, sf_dir):
    """Longest increasing run of turn lengths in each conversation."""
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", F.length("text").alias("n")))), lambda x: x["n"])
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("n"))
    return rows.select("conv_id", F.size("n").cast("long").alias("n_turns"), fidelity.lis_length(F.col("n")).cast("long").alias("lis"))


QUERIES = {
    f.__name__: f
    for f in (
        normalize_whitespace, html_escape, ligatures_dehyphenate, comparison_form, canonicalize_nfkc, token_extract, doc_stats, html_text, media_types, segment_chunks,
        chunk_contains, fidelity_score, fuzzy_find, completeness_score, missing_chunks, reconcile_tokens, fidelity_report, order_score_lis,
    )
}

_LIS = """CASE WHEN len({0}) = 0 THEN 0 ELSE len(list_reduce(list_transform({0}, lambda p: [p]), lambda t, x: list_concat(list_concat(list_filter(t, lambda y: y < x[1]), x), t[len(list_filter(t, lambda y: y < x[1])) + 2:]))) END"""
_CHUNKS = f"""src AS (SELECT doc_id, trim(regexp_replace(source, '\\s+', ' ', 'g')) AS s, trim(regexp_replace(target, '\\s+', ' ', 'g')) AS t FROM pairs),
chunks AS (
  SELECT doc_id, k::INT AS chunk_no, (k * 500)::INT AS start_index, least(k * 500 + 600, length(s))::INT AS end_index, substr(s, k * 500 + 1, 600) AS text, length(s) - k * 500 < 600 AS is_partial
  FROM (SELECT doc_id, s, unnest(range(greatest(0, ceil((length(s) - 600) / 500.0)::BIGINT) + 1)) AS k FROM src WHERE length(s) > 0))"""
_DOCS = "pairs AS (SELECT doc_id, text AS source, text AS target FROM documents)"
_EXACT = f"""{validate.DAMAGED_SQL}, {_CHUNKS},
r AS (
  SELECT doc_id, -1 AS chunk_no, 0::BIGINT AS cur, -1::BIGINT AS pos FROM src
  UNION ALL
  SELECT doc_id, chunk_no, CASE WHEN p >= 0 THEN p + n ELSE cur END, p FROM (
    SELECT r.doc_id, c.chunk_no, r.cur, length(c.text) AS n, CASE WHEN instr(substr(t, r.cur + 1), c.text) > 0 THEN instr(substr(t, r.cur + 1), c.text) + r.cur ELSE instr(t, c.text) END - 1 AS p
    FROM r JOIN chunks c ON c.doc_id = r.doc_id AND c.chunk_no = r.chunk_no + 1 JOIN src ON src.doc_id = r.doc_id))"""
_MATCHES = f"""{validate.DAMAGED_SQL}, {_CHUNKS},
w AS (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]{{4,}}') AS words FROM chunks),
r AS (
  SELECT doc_id, -1 AS chunk_no, 0::BIGINT AS cur, -1::BIGINT AS pos, '' AS kind FROM src
  UNION ALL
  SELECT doc_id, chunk_no, CASE WHEN p >= 0 THEN p + n ELSE cur END, CASE WHEN p >= 0 THEN p WHEN near THEN base + instr(win, found[1]) - 1 ELSE -1 END,
    CASE WHEN p >= 0 THEN 'exact' WHEN near THEN 'fuzzy' ELSE 'missing' END
  FROM (SELECT *, len(words) > 0 AND len(found) >= 0.85 * len(words) AS near FROM (SELECT *, CASE WHEN p < 0 THEN list_filter(words, lambda x: contains(win, x)) END AS found FROM (
    SELECT *, CASE WHEN cur + n > length(t) OR length(substr(t, cur + 1, 10000)) < n THEN t ELSE substr(t, cur + 1, 10000) END AS win,
      CASE WHEN cur + n > length(t) OR length(substr(t, cur + 1, 10000)) < n THEN 0 ELSE cur END AS base FROM (
    SELECT r.doc_id, c.chunk_no, r.cur, c.words, t, length(c.text) AS n, CASE WHEN instr(substr(t, r.cur + 1), c.text) > 0 THEN instr(substr(t, r.cur + 1), c.text) + r.cur ELSE instr(t, c.text) END - 1 AS p
    FROM r JOIN w c ON c.doc_id = r.doc_id AND c.chunk_no = r.chunk_no + 1 JOIN src ON src.doc_id = r.doc_id)))))"""
_SEEDED = "seeded AS (SELECT doc_id, 'ﬁne æon so' || chr(173) || 'ft inter-  ' || chr(10) || '  national ' || text || ' first- and third-person , a — b 12. last' AS text FROM documents)"
_LIGATURES = "text"
for _old, _new in fn.LIGATURES:
    _LIGATURES = f"replace({_LIGATURES}, '{_old}', '{_new}')"
_DEHYPHENATED = "regexp_replace(replace({0}, chr(173), ''), '-\\s*\\n\\s*', '', 'g')"
#: DuckDB composes characters only; the compatibility characters that the seeded texts hold are among the ligatures.
CANONICAL = _DEHYPHENATED.format(_LIGATURES.replace("text", "nfc_normalize({0})"))
_W = "[\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}]"
_COMPARISON = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace({{0}}, '\\s+([,.:;!?])', '\\1', 'g'), '—', '-'), '–', '-'), '\\b(\\d{{{{1,3}}}})\\.\\s', '\\1 ', 'g'),
  '({_W})-\\s+', '\\1 ', 'g'), '({_W})-({_W})', '\\1 \\2', 'g'), '({_W})-({_W})', '\\1 \\2', 'g')"""
_UNESCAPED = "x"
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char}')"
#: Text nodes of HTML, each without blanks at its ends, joined by blanks. Scripts, styles, comments and declarations go.
TAGLESS = f"""array_to_string(list_filter(list_transform(string_split_regex(regexp_replace({{0}}, '(?is)<!--.*?-->|<!\\w[^>]*>|<[?][^>]*>|<script\\b.*?</script>|<style\\b.*?</style>', chr(1), 'g'), '<[^>]*>|' || chr(1)),
  lambda x: trim({_UNESCAPED}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> ''), ' ')"""
_SCORES = """CASE WHEN n_chunks = 0 THEN 100.0 ELSE n_found * 100.0 / n_chunks END::DOUBLE AS completeness, CASE WHEN n_found = 0 THEN 100.0 ELSE lis * 100.0 / n_found END::DOUBLE AS order_score"""

_COMPLETE = f"""{_MATCHES}, p AS (
  SELECT r.doc_id, count(*) FILTER (r.chunk_no >= 0)::INT AS n_chunks, count(*) FILTER (kind = 'exact')::INT AS n_exact, count(*) FILTER (kind = 'fuzzy')::INT AS n_fuzzy,
    count(*) FILTER (kind = 'missing' AND length(trim(c.text)) >= 20)::INT AS n_failed, coalesce(list(pos ORDER BY r.chunk_no) FILTER (kind IN ('exact', 'fuzzy')), []) AS l
  FROM r LEFT JOIN chunks c ON c.doc_id = r.doc_id AND c.chunk_no = r.chunk_no GROUP BY 1
), q AS (SELECT doc_id, n_chunks, n_exact, n_fuzzy, n_failed, n_exact + n_fuzzy AS n_found, ({_LIS.format("l")})::INT AS lis FROM p),
s AS (SELECT *, {_SCORES}, n_failed = 0 AS is_valid FROM q), verdicts AS (SELECT *, CASE WHEN completeness >= 95 AND order_score >= 80 THEN 'pass' ELSE 'fail' END AS status FROM s)"""
_MISSED = "SELECT doc_id, chunk_no, start_index, text FROM r JOIN chunks USING (doc_id, chunk_no) WHERE kind = 'missing' AND length(trim(text)) >= 20"

ORACLES = {
    "normalize_whitespace": "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
    "ligatures_dehyphenate": f"WITH {_SEEDED} SELECT doc_id, regexp_replace(replace({_LIGATURES}, chr(173), ''), '-\\s*\\n\\s*', '', 'g') AS text FROM seeded",
    "token_extract": "SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]{4,}')) AS token FROM documents) GROUP BY 1, 2",
    "doc_stats": "SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_words, length(text)::BIGINT AS n_chars, substr(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 1, 160) AS snippet FROM documents",
    "media_types": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/gif' ELSE 'image/png' END AS media_type,
      'scan.' || event_type || '.' || CASE event_id % 4 WHEN 0 THEN 'png' WHEN 1 THEN 'jpg' WHEN 2 THEN 'gif' ELSE 'tiff' END AS filename FROM events""",
    "segment_chunks": f"WITH {_DOCS}, {_CHUNKS} SELECT * FROM chunks",
    "chunk_contains": "SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "fidelity_score": f"""WITH RECURSIVE {_EXACT}, p AS (
      SELECT doc_id, count(*) FILTER (chunk_no >= 0)::INT AS n_chunks, count(*) FILTER (pos >= 0)::INT AS n_found, coalesce(list(pos ORDER BY chunk_no) FILTER (pos >= 0), []) AS l FROM r GROUP BY 1
    ), q AS (SELECT doc_id, n_chunks, n_found, ({_LIS.format("l")})::INT AS lis FROM p) SELECT *, {_SCORES} FROM q""",
    "fuzzy_find": f"WITH RECURSIVE {_MATCHES} SELECT doc_id, chunk_no, pos::INT AS pos, kind FROM r WHERE chunk_no >= 0",
    "comparison_form": f"WITH {_SEEDED} SELECT doc_id, {_COMPARISON.format('text')} AS text FROM seeded",
    "canonicalize_nfkc": f"WITH {_SEEDED} SELECT doc_id, regexp_replace({CANONICAL.format('text')}, '\\p{{C}}', '', 'g') AS text FROM seeded",
    "html_text": f"SELECT page_id, {TAGLESS.format('html')} AS text FROM pages",
    "completeness_score": f"WITH RECURSIVE {_COMPLETE} SELECT * FROM verdicts",
    "missing_chunks": f"WITH RECURSIVE {_MATCHES} {_MISSED}",
    "reconcile_tokens": f"""WITH RECURSIVE {_MATCHES}, f AS ({_MISSED}),
      g AS (SELECT f.doc_id, chunk_no, regexp_extract_all(lower({_COMPARISON.format('f.text')}), '[\\p{{L}}\\p{{N}}_]{{4,}}') AS words, tc FROM f JOIN (SELECT doc_id, lower({_COMPARISON.format('t')}) AS tc FROM src) USING (doc_id)),
      h AS (SELECT doc_id, chunk_no, len(words) AS n, len(list_filter(words, lambda x: contains(tc, x))) AS found FROM g)
      SELECT doc_id, chunk_no, CASE WHEN n > 0 THEN round(found / n, 4) ELSE 0 END AS coverage, CASE WHEN n > 0 AND found >= 0.98 * n THEN 'approximate' ELSE 'unresolved' END AS resolution FROM h""",
    "fidelity_report": f"""WITH RECURSIVE {_COMPLETE}, f AS ({_MISSED}),
      m AS (SELECT doc_id, list(substr(trim(text), 1, 160) ORDER BY chunk_no)[1:3] AS missing FROM f GROUP BY 1)
      SELECT doc_id, to_json({{'status': status, 'summary': {{'completeness': completeness, 'order_score': order_score, 'n_chunks': n_chunks, 'n_exact': n_exact, 'n_fuzzy': n_fuzzy, 'n_failed': n_failed}},
        'missing': coalesce(missing, []::VARCHAR[])}})::VARCHAR AS report FROM verdicts LEFT JOIN m USING (doc_id)""",
    "order_score_lis": f"SELECT conv_id, len(l)::BIGINT AS n_turns, ({_LIS.format('l')})::BIGINT AS lis FROM (SELECT conv_id, list(length(text) ORDER BY turn) AS l FROM conversations GROUP BY 1)",
}
