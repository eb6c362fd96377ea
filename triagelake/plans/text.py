"""Queries over mail bodies, pages and documents as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import language as G
from ..functions import text as T
from ..operators import sections as S
from ..sources.tables import table
from .registry import query

#: Turns as mail bodies, each with the turn before it quoted by one of three conventions.
BODIES = """
SELECT conv_id, turn, CASE WHEN prev IS NULL THEN text
  WHEN turn % 4 = 1 THEN concat(text, chr(10), 'On Mon 3 June, ', role, ' wrote:', chr(10), '> ', replace(prev, chr(10), concat(chr(10), '> ')))
  WHEN turn % 4 = 2 THEN concat(text, chr(10), '-----Original Message-----', chr(10), prev)
  WHEN turn % 4 = 3 THEN concat('From: ', role, chr(10), 'Sent: today', chr(10), prev)
  ELSE concat(text, chr(10), '-- ', chr(10), role, chr(10), '> a', chr(10), '> b', chr(10), '> c') END AS body
FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM {conversations})"""


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


START_SQL = "coalesce(least(" + ", ".join(f"CASE WHEN regexp_matches(body, {sql_text(p)}) THEN length(string_split_regex(body, {sql_text(p)})[1]) END" for p in T.QUOTE_MARKS) + "), -1)"


@query(
    "X12 X13",
    "WITH b AS (" + BODIES.format(conversations="conversations") + f"), s AS (SELECT *, CAST({START_SQL} AS INT) AS start FROM b),"
    r"""n AS (SELECT *, CASE WHEN start < 0 THEN body ELSE rtrim(regexp_replace(substr(body, 1, start), '\s+$', '')) END AS new_text FROM s)
SELECT conv_id, turn, start, new_text, CASE WHEN start < 0 THEN '' ELSE substr(body, start + 1) END AS quoted, start >= 0 AND length(trim(new_text)) < 40 AS mostly_quoted,
  CASE WHEN regexp_matches(new_text, '(?m)^--\s*$') THEN regexp_replace(string_split_regex(new_text, '(?m)^--\s*$')[1], '\s+$', '') ELSE new_text END AS unsigned FROM n""",
)
def quote_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = spark.sql(BODIES, conversations=table(spark, sf_dir, "conversations")).withColumn("start", T.quote_start(F.col("body")))
    body, start = F.col("body"), F.col("start")
    return bodies.select(
        "conv_id", "turn", "start", T.new_text(body, start).alias("new_text"), T.quoted_text(body, start).alias("quoted"),
        T.mostly_quoted(body, start).alias("mostly_quoted"), T.without_signature(T.new_text(body, start)).alias("unsigned"),
    )


@query(
    "X14 X15 J17 J18",
    r"""WITH m AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '<' || (doc_id // 2) || '@example.org>' ELSE repeat('x', 180) || '-' || (doc_id // 4) || '-' || repeat('y', 20) END AS mid, source, text FROM documents),
k AS (SELECT doc_id, sha256(text) AS content, CASE WHEN mid IS NULL THEN 'hash:' || sha256(source || lang_ || lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) WHEN length(mid) <= 190 THEN mid ELSE 'mid-sha:' || sha256(mid) END AS key
  FROM (SELECT *, '' AS lang_ FROM m))
SELECT doc_id, key, min(doc_id) OVER (PARTITION BY key) AS first_id, count(*) OVER (PARTITION BY content) AS blob_uses FROM k""",
)
def dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    half, quarter = (F.floor(F.col("doc_id") / n).cast("string") for n in (2, 4))
    mid = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("<"), half, F.lit("@example.org>"))).when(
        F.col("doc_id") % 3 == 2, F.concat(F.lit("x" * 180 + "-"), quarter, F.lit("-" + "y" * 20))
    )
    keyed = table(spark, sf_dir, "documents").select(
        "doc_id", T.dedupe_key(mid, F.col("source"), F.lit(""), F.lit(""), F.col("text")).alias("key"), F.sha2("text", 256).alias("content")
    )
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first_id"))
    blobs = keyed.groupBy("content").agg(F.count("*").alias("blob_uses"))
    return keyed.join(first, "key").join(blobs, "content").select("doc_id", "key", "first_id", "blob_uses")


@query(
    "X16",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<(/?)(p|div|br|li|tr|h[1-6]|article|section|header|footer|ul|ol|table|blockquote|nav|title)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM b)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM c""",
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


#: Blocks with headings among them: every fifth line of a document is one of a list.
TITLES = ("References:", "ACKNOWLEDGMENTS", "Conflict of interest", "Funding sources", "Abstract", "Background", "Materials and  Methods", "Case report 1", "Ergebnisse", "Diskussion", "Conclusions", "Key words:", "1. Patient details", "Unknown title")
TITLE_CASE = "CASE (doc_id + n) % 14 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(TITLES)) + " END"
LINES_SQL = f"""l AS (SELECT doc_id, n, CASE WHEN n % 5 = 2 THEN {TITLE_CASE} ELSE line END AS block FROM (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS n, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))),
"""
KIND_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(lower(bare), {sql_text('^(' + p + ')$')}) THEN '{k}' END" for k, p in T.HEADINGS) + ")"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    title = F.element_at(F.array(*map(F.lit, TITLES)), ((F.col("doc_id") + F.col("n")) % 14 + 1).cast("int"))
    return lines.select("doc_id", "n", F.when(F.col("n") % 5 == 2, title).otherwise(F.col("line")).alias("block"))


@query(
    "X18 X19 X20 P14",
    "WITH "
    + LINES_SQL
    + rf"""b AS (SELECT *, trim(regexp_replace(trim(block), '[:.]+$', '')) AS bare FROM l)
SELECT doc_id, CAST(n AS INT) AS n, CASE WHEN bare <> '' AND length(bare) <= 90 THEN {KIND_SQL} END AS kind, regexp_matches(trim(block), '(?i)^\s*(section\s+)?([A-H]|\d{{1,2}})[.)]\s+\S.{{0,80}}$') AS form_section,
  trim(block) <> '' AND length(trim(block)) <= 90 AND (n % 2 = 0 OR n % 3 >= 10 * 1.12) AS typographic FROM b""",
)
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.col("block")
    look = T.looks_like_heading(b, F.col("n") % 2 == 0, (F.col("n") % 3).cast("double"), F.lit(10.0))
    return blocks(spark, sf_dir).select("doc_id", "n", T.heading_kind(b).alias("kind"), T.is_form_section(b).alias("form_section"), look.alias("typographic"))


SECTIONS_SQL = (
    "WITH "
    + LINES_SQL
    + f"""b AS (SELECT *, trim(regexp_replace(trim(block), '[:.]+$', '')) AS bare, sum(length(block) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - length(block) - 1 AS s FROM l),
k AS (SELECT *, CASE WHEN bare <> '' AND length(bare) <= 40 THEN {KIND_SQL} END AS kind FROM b),
g AS (SELECT *, count(kind) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM k),
x AS (SELECT doc_id, section, coalesce(max(kind), 'TITLE') AS kind, coalesce(max(CASE WHEN kind IS NOT NULL THEN trim(block) END), '(document start)') AS heading, min(s)::INT AS char_start, max(s + length(block))::INT AS char_end,
   string_agg(block, chr(10) ORDER BY n) AS body FROM g GROUP BY 1, 2),
e AS (SELECT *, kind IN ('REFERENCES', 'ACKNOWLEDGEMENTS', 'CONFLICT_OF_INTEREST', 'FUNDING') AS excluded FROM x) """
)


@query("R19 W02 W03 P15", SECTIONS_SQL + "SELECT doc_id, section::INT AS section, kind, heading, char_start, char_end, excluded FROM e")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections(blocks(spark, sf_dir))


@query(
    "P16",
    SECTIONS_SQL
    + """, d AS (SELECT doc_id, string_agg(CASE WHEN excluded THEN chr(10) || '[section ''' || heading || ''' withheld from case extraction]' || chr(10) || CASE WHEN last THEN '' ELSE chr(10) END ELSE body || CASE WHEN last THEN '' ELSE chr(10) END END, '' ORDER BY section) AS text
  FROM (SELECT *, section = max(section) OVER (PARTITION BY doc_id) AS last FROM e) GROUP BY 1)
SELECT doc_id, md5(text) AS redacted_md5 FROM d""",
)
def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir)
    text = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda r: r["block"]), "\n").alias("text"))
    hidden = S.sections(rows).where("excluded").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("char_start").alias("s"), F.col("char_end").alias("e"), "heading"))).alias("spans"))
    joined = text.join(hidden, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<s:int,e:int,heading:string>>")))
    return joined.select("doc_id", F.md5(T.redacted(F.col("text"), F.col("spans"))).alias("redacted_md5"))


MARKS_SQL = " + ".join(f"regexp_matches(low, {sql_text(p)})::INT" for p in T.ARTICLE_MARKS)
FORMS_SQL = " + ".join(f"regexp_matches(low, {sql_text(p)})::INT" for p in T.FORM_TITLES)
#: Pages with some furniture, so that every step of the genre decision occurs.
FURNISHED = """SELECT doc_id, source, CASE doc_id % 6 WHEN 0 THEN concat('Abstract', chr(10), text, chr(10), 'Keywords: x', chr(10), 'Introduction', chr(10), 'References') WHEN 1 THEN concat('Adverse event report', chr(10), 'Patient: A', chr(10), 'Dose: 5')
  WHEN 2 THEN concat('Name: x', chr(10), 'Date: y', chr(10), substr(text, 1, 30)) WHEN 3 THEN concat('see discussion', chr(10), text) WHEN 4 THEN substr(text, 1, 60) ELSE text END AS text, CAST(doc_id % 3 AS INT) AS columns FROM {documents}"""
GENRE_SQL = (
    "WITH f AS ("
    + FURNISHED.format(documents="documents")
    + f"""), a AS (SELECT *, lower(text) AS low, length(regexp_replace(text, '[^' || chr(10) || ']', '', 'g')) + 1 AS lines, len(regexp_extract_all(text, {sql_text(T.LABEL_LINE)}))::DOUBLE AS labels FROM f),
m AS (SELECT *, {MARKS_SQL} AS articles, {FORMS_SQL} AS forms, labels / lines AS density, round(length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}\\p{{P}}\\p{{S}}\\s]', '', 'g'))::DOUBLE / length(text), 6) AS printable FROM a),
g AS (SELECT *, CASE WHEN forms > 0 AND density > 0.20 THEN 'FORM' WHEN density > 0.45 AND articles < 3 THEN 'FORM' WHEN columns >= 2 AND articles >= 2 THEN 'ARTICLE' WHEN articles >= 4 THEN 'ARTICLE' WHEN columns >= 2 AND articles >= 1 THEN 'ARTICLE'
   WHEN forms > 0 THEN 'FORM' ELSE 'LETTER' END AS genre, CASE WHEN length(text) < 100 THEN 'only ' || length(text) || ' extractable characters' WHEN doc_id % 11 = 0 THEN 'a single image covers the page' WHEN printable < 0.75 THEN 'the text layer is mostly not printable' END AS scanned FROM m) """
)


def flavours(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.sql(FURNISHED, documents=table(spark, sf_dir, "documents"))
    area = F.when(F.col("doc_id") % 11 == 0, 0.95).otherwise(0.1)
    scanned = T.scanned_reason(F.length("text"), area, T.printable_ratio(F.col("text")))
    return pages.select("doc_id", "source", F.length("text").alias("chars"), F.round(T.printable_ratio(F.col("text")), 6).alias("printable"), T.genre(F.col("text"), F.col("columns")).alias("genre"), scanned.alias("scanned"))


@query("X21 X22 X23", GENRE_SQL + "SELECT doc_id, printable, genre, scanned FROM g")
def page_flavour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flavours(spark, sf_dir).select("doc_id", "printable", "genre", "scanned")


@query(
    "A35",
    GENRE_SQL
    + """, w AS (SELECT source, genre, sum(length(text)) AS c FROM g GROUP BY 1, 2), s AS (SELECT source, sum(c) AS total, max(c) AS most, arg_max(genre, c) AS top FROM w GROUP BY 1)
SELECT s.source, CASE WHEN most >= 0.70 * total THEN top ELSE 'MIXED' END AS genre, (SELECT CASE WHEN count(DISTINCT scanned IS NULL) > 1 THEN 'MIXED' WHEN bool_and(scanned IS NULL) THEN 'DIGITAL' ELSE 'SCANNED' END FROM g WHERE g.source = s.source) AS rendering FROM s""",
)
def flavour_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendering and genre of whole documents (sources stand for them), by weight of characters."""
    pages = flavours(spark, sf_dir)
    weights = pages.groupBy("source", "genre").agg(F.sum("chars").alias("c"))
    top = weights.groupBy("source").agg(F.sum("c").alias("total"), F.max("c").alias("most"), F.max_by("genre", "c").alias("top"))
    digital = F.col("scanned").isNull()
    seen = pages.groupBy("source").agg(F.when(F.bool_and(digital), "DIGITAL").when(~F.bool_or(digital), "SCANNED").otherwise("MIXED").alias("rendering"))
    return top.join(seen, "source").select("source", F.when(F.col("most") >= 0.70 * F.col("total"), F.col("top")).otherwise("MIXED").alias("genre"), "rendering")


NAMES = ("English", " Deutsch ", "français", "eng", "EN", "unknown", "", "klingon", "n/a", "日本語", "xx-yy", "pt")
CODES = ("en", "de", "fr", "en", "en", None, None, "kl", None, "ja", None, "pt")


@query(
    "X26 P17",
    "SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN {sql_text(c) if c else 'NULL'}" for k, c in enumerate(CODES)) + " END AS code, coalesce(doc_id % 12 IN (1, 2, 7, 9, 11), false) AND length(trim(text)) >= 120 AS translate FROM documents",
)
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 12 + 1).cast("int"))
    code = T.language_code(said)
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), T.needs_translation(F.col("text"), code).alias("translate"))


def known_sql(words: tuple[str, ...]) -> str:
    return "len(list_filter(words, lambda w: list_contains([" + ", ".join(f"'{w}'" for w in words) + "], w)))"


DETECT_SQL = (
    r"""WITH w AS (SELECT doc_id, source, lang, trim(text) AS bare, string_split_regex(lower(regexp_replace(text, '[^\p{L}\s]', ' ', 'g')), '\s+') AS words FROM documents),
v AS (SELECT *, """
    + ", ".join(f"{known_sql(k)} AS {c}_" for c, k in G.FUNCTION_WORDS.items())
    + r""", length(regexp_replace(bare, '[\p{L}\s]', '', 'g')) AS odd, length(regexp_replace(bare, '\p{Nd}', '', 'g')) AS undigit FROM w),
s AS (SELECT *, en_ + de_ + fr_ + es_ AS total, greatest(en_, de_, fr_, es_) AS most, length(bare) >= 25 AND len(list_filter(string_split_regex(bare, '\s+'), lambda w: w <> '')) >= 3
   AND (length(bare) - odd)::DOUBLE / length(bare) >= 0.70 AND (length(bare) - undigit)::DOUBLE / length(bare) <= 0.12 AS ok FROM v),
d AS (SELECT *, CASE WHEN ok THEN round(coalesce(most::DOUBLE / nullif(total, 0), 0), 4) ELSE 0 END AS confidence, CASE WHEN en_ = most THEN 'en' WHEN de_ = most THEN 'de' WHEN fr_ = most THEN 'fr' ELSE 'es' END AS first FROM s),
r AS (SELECT doc_id, source, lang, bare, CASE WHEN ok AND confidence >= 0.6 THEN first END AS language, confidence FROM d) """
)


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.detect(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "text")


@query("X27 X28 X29", DETECT_SQL + "SELECT doc_id, language, confidence FROM r")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).select("doc_id", "language", "confidence")


@query(
    "A33 A34 X28",
    DETECT_SQL
    + """, w2 AS (SELECT source, language, sum(length(bare))::DOUBLE AS weight FROM r WHERE language IS NOT NULL GROUP BY 1, 2),
t AS (SELECT source, sum(weight) AS total FROM w2 GROUP BY 1)
SELECT w2.source, language, weight, rank() OVER (PARTITION BY w2.source ORDER BY weight DESC, language) = 1 AS is_primary, weight / total >= 0.10 AS listed FROM w2 JOIN t USING (source)""",
)
def language_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of whole documents (sources stand for them), weighted by content."""
    weights = detected(spark, sf_dir).where("language is not null").groupBy("source", "language").agg(F.sum(T.content_weight(F.col("text"))).cast("double").alias("weight"))
    whole = Window.partitionBy("source")
    return weights.select(
        "source", "language", "weight", (F.row_number().over(whole.orderBy(F.desc("weight"), "language")) == 1).alias("is_primary"), (F.col("weight") / F.sum("weight").over(whole) >= 0.10).alias("listed")
    )


@query("X24 X25 U03")
def summary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and chunks of each document; the tests hold both against plain Python."""
    parts = T.chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), 2000)
    labelled = F.transform(parts, lambda p, i: F.concat(F.lit("[Part "), (i + 1).cast("string"), F.lit(" of "), F.size(parts).cast("string"), F.lit("]\n"), p))
    return table(spark, sf_dir, "documents").select("doc_id", T.sentence_count(F.col("text")).alias("sentences"), F.size(parts).alias("parts"), F.md5(F.array_join(labelled, "\n\n")).alias("combined_md5"))
