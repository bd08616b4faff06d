"""Dropping lines that follow a template which recurs across documents, in DataFrame and SQL functions only.

A fixed-depth tree sorts lines by their number of tokens and then by their leading ``LEAD`` tokens; tokens with a digit
are variable from the start and stand as ``<*>``. In a leaf every position keeps the token that more than half of the
leaf's (document, form) pairs have there and is variable elsewhere; that is the leaf's template. A line belongs to it if
at least ``SIMILARITY`` of its tokens agree with it; other lines of the leaf are templates of their own. A template that occurs in at
least ``LEAST_DOCUMENTS`` documents recurs, and all its lines go.

Only counts per leaf, form and document are shuffled. Leaves seen in too few documents are left out before their lines
are looked at, and forms are counted before their tokens are spread, so a line that a third of all documents have is one
row there.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stationweave.llm._common import free_name, prepare, small_side, written

LEAD = 3
LEAST_TOKENS = 5
SIMILARITY = 0.8
LEAST_DOCUMENTS = 3


def _lines(docs: DataFrame, id_column: str, text_column: str, least_tokens: int) -> DataFrame:
    """``_id, _text`` (hash of the text), ``_line`` (number from 0), ``_form`` (tokens joined by a space, variable ones
    masked), ``_leaf``."""
    # Whole texts are tidied before they are cut, so that the costly patterns run once a text and no filter repeats them.
    # Only white space that isn't a single blank is touched; line ends stay.
    tidy = F.regexp_replace(text_column, r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*+|\x20[\x20\x09\x0B-\x0D]++", " ")
    # Anchored at token starts and possessive, so a token of any length is passed once.
    masked = F.regexp_replace(tidy, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")
    rows = docs.select(F.col(id_column).alias("_id"), F.xxhash64(text_column).alias("_text"), F.posexplode(F.split(masked, "\n")).alias("_line", "_raw"))
    tokens = F.split("_form", " ")
    return (rows.select("_id", "_text", "_line", F.trim("_raw").alias("_form"))
            .withColumn("_n", F.size(tokens)).where((F.col("_form") != "") & (F.col("_n") >= least_tokens))
            .withColumn("_leaf", F.concat_ws(" ", F.col("_n").cast("string"), F.slice(tokens, 1, LEAD))).drop("_n"))


def recurring_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    least_documents: int = LEAST_DOCUMENTS, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``_id, _text, _lines``: the numbers of the lines that go, for each id and hash of a text that loses any.

    A document is an id with a text: rows that repeat both are one, with or without an id, and others are apart.
    """
    prepare(docs.sparkSession)
    lines = _lines(docs, id_column, text_column, least_tokens)
    busy = (lines.select("_leaf", "_id", "_text").distinct().groupBy("_leaf").count()
            .where(F.col("count") >= least_documents).select("_leaf"))
    busy = written(busy, "busy-leaves")
    held = written(lines.join(small_side(busy), "_leaf"), "busy-lines")
    pairs = written(held.select("_leaf", "_form", "_id", "_text").distinct(), "line-forms")
    forms = written(pairs.groupBy("_leaf", "_form").agg(F.count(F.lit(1)).alias("_docs")), "form-counts")

    tokens = forms.select("_leaf", "_docs", F.posexplode(F.split("_form", " ")).alias("_at", "_token"))
    kept = (tokens.groupBy("_leaf", "_at", "_token").agg(F.sum("_docs").alias("_with"))
            .groupBy("_leaf", "_at").agg(F.max_by("_token", "_with").alias("_token"), F.max("_with").alias("_with"),
                                         F.sum("_with").alias("_all"))
            .where((2 * F.col("_with") > F.col("_all")) & (F.col("_token") != "<*>")))
    template = kept.groupBy("_leaf").agg(F.map_from_entries(F.collect_list(F.struct("_at", "_token"))).alias("_template"))
    agree = F.expr("size(filter(split(_form, ' '), (t, i) -> t <=> _template[i]))")
    own = agree >= SIMILARITY * F.size(F.split("_form", " "))
    placed = forms.join(template, "_leaf", "left").select(
        "_leaf", "_form", F.when(~F.coalesce(own, F.lit(False)), F.col("_form")).alias("_own"))
    placed = written(placed, "form-templates")
    # A null in _own stands for the template of the leaf.
    met = pairs.join(placed, ["_leaf", "_form"]).select("_leaf", "_own", "_id", "_text").distinct()
    recurring = (met.groupBy("_leaf", "_own").count().where(F.col("count") >= least_documents)
                 .select(F.col("_leaf").alias("_l"), F.col("_own").alias("_o")))
    gone = placed.join(recurring, (F.col("_leaf") == F.col("_l")) & F.col("_own").eqNullSafe(F.col("_o"))).select("_leaf", "_form")
    return (held.join(small_side(written(gone, "recurring-forms")), ["_leaf", "_form"])
            .groupBy("_id", "_text").agg(F.collect_set("_line").alias("_lines")))


def drop_recurring(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least_documents: int = LEAST_DOCUMENTS,
                   dropped: str | None = None, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``docs`` without the recurring lines in their texts; ``dropped`` names a column for the number of lines gone.

    A null text stays null and an empty one empty. Lines of fewer than ``least_tokens`` tokens stay; with 1 every line that isn't blank
    is judged. A text all of whose lines go becomes empty. Rows that repeat an id, or have none, each lose the recurring lines of their own
    text. All other columns stay, whatever they are called.
    """
    of, hashed, numbers = (free_name(docs, n) for n in ("__of", "__text", "__gone"))
    gone = recurring_lines(docs, id_column, text_column, least_documents, least_tokens).withColumnsRenamed(
        {"_id": of, "_text": hashed, "_lines": numbers})
    gone = written(gone, "recurring-lines")
    joined = docs.join(gone, F.col(id_column).eqNullSafe(F.col(of)) & (F.xxhash64(text_column) == F.col(hashed)), "left")
    rest = F.array_join(F.filter(F.split(text_column, "\n"), lambda x, i: ~F.array_contains(numbers, i)), "\n")
    text = F.when(F.col(numbers).isNull(), F.col(text_column)).otherwise(rest)
    columns = [text.alias(c) if c == text_column else F.col(f"`{c}`") for c in docs.columns]
    if dropped:
        columns.append(F.coalesce(F.size(numbers), F.lit(0)).cast("long").alias(dropped))
    return joined.select(*columns)


# The same rules for a comparison over the table ``documents``.
SQL = rf"""
WITH lines AS (
  SELECT doc_id, i - 1 AS line, list_filter(regexp_split_to_array(raw, '[\x20\x09-\x0D]+'), lambda t: t <> '') AS tokens
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i
        FROM documents WHERE text IS NOT NULL)),
forms AS (
  SELECT doc_id, line, len(tokens) AS n,
         list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS form
  FROM lines WHERE len(tokens) >= {LEAST_TOKENS}),
leaves AS (SELECT doc_id, line, n, form, n || ' ' || array_to_string(form[1:{LEAD}], ' ') AS leaf FROM forms),
busy AS (SELECT leaf FROM leaves GROUP BY leaf HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
counted AS (SELECT leaf, form, n, count(DISTINCT doc_id) AS docs FROM leaves SEMI JOIN busy USING (leaf) GROUP BY ALL),
tokens AS (SELECT leaf, docs, unnest(form) AS token, generate_subscripts(form, 1) AS place FROM counted),
seen AS (SELECT leaf, place, token, sum(docs) AS n FROM tokens GROUP BY ALL),
kept AS (SELECT leaf, place, max_by(token, n) AS token FROM seen GROUP BY leaf, place
         HAVING 2 * max(n) > sum(n) AND max_by(token, n) <> '<*>'),
agreeing AS (
  SELECT t.leaf, t.form, count(k.token) AS agree
  FROM (SELECT leaf, form, unnest(form) AS token, generate_subscripts(form, 1) AS place FROM counted) t
  LEFT JOIN kept k ON k.leaf = t.leaf AND k.place = t.place AND k.token = t.token GROUP BY ALL),
placed AS (SELECT leaf, form, CASE WHEN agree >= {SIMILARITY} * len(form) THEN NULL ELSE form END AS own FROM agreeing),
recurring AS (
  SELECT p.leaf, p.own FROM placed p JOIN leaves l ON l.leaf = p.leaf AND l.form = p.form
  GROUP BY ALL HAVING count(DISTINCT l.doc_id) >= {LEAST_DOCUMENTS}),
gone AS (SELECT p.leaf, p.form FROM placed p JOIN recurring r ON r.leaf = p.leaf AND r.own IS NOT DISTINCT FROM p.own),
dropped AS (SELECT DISTINCT l.doc_id, l.line FROM leaves l JOIN gone g ON g.leaf = l.leaf AND g.form = l.form),
left_over AS (
  SELECT d.doc_id, string_agg(x.raw, chr(10) ORDER BY x.i) FILTER (WHERE g.line IS NULL) AS rest, count(g.line) AS n
  FROM documents d, LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS raw,
                                    generate_subscripts(string_split(d.text, chr(10)), 1) AS i) x
  LEFT JOIN dropped g ON g.doc_id = d.doc_id AND g.line = x.i - 1 GROUP BY d.doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(o.n, 0) AS BIGINT) AS n_dropped,
       CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(o.rest, '')) END AS text_md5
FROM documents d LEFT JOIN left_over o USING (doc_id)
"""

# The same with lines of any length in the tree.
ALL_SQL = SQL.replace(f"len(tokens) >= {LEAST_TOKENS}", "len(tokens) >= 1")
