"""Text items, predicates and clean-up over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from .registry import query, table

ITEMS = r"""i AS (SELECT doc_id, lang, text AS uk, text IS NULL OR text = '' OR regexp_full_match(text, '\s*[0-9]+([–-][0-9]+)?\s*') OR regexp_full_match(text, '[\x00-\x7F]*') AS en_set FROM documents)"""


def items(spark, sf_dir):
    """(doc_id, lang, item): text items of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", text.text_item(F.col("text")).alias("item"))


@query(f"WITH {ITEMS} SELECT doc_id, uk, CASE WHEN en_set THEN uk END AS en, en_set FROM i")
def q_text_item(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", "item.*")


@query(f"WITH {ITEMS} SELECT doc_id, CASE WHEN en_set AND doc_id % 7 <> 0 THEN uk WHEN en_set THEN NULL ELSE uk END AS shown FROM i")
def q_get_text(spark, sf_dir):
    """The translation where one is set, even to null."""
    i = items(spark, sf_dir)
    en = F.when(F.col("doc_id") % 7 != 0, F.col("item.en"))
    changed = F.struct(F.col("item.uk").alias("uk"), en.alias("en"), F.col("item.en_set").alias("en_set"))
    return i.select("doc_id", text.get_text(changed).alias("shown"))


@query(
    f"""WITH {ITEMS} SELECT a.doc_id, CASE WHEN a.en_set AND b.en_set THEN (CASE WHEN a.en_set THEN a.uk END) IS NOT DISTINCT FROM (CASE WHEN b.en_set THEN b.uk END)
ELSE a.uk IS NOT DISTINCT FROM b.uk END AS same FROM i a JOIN i b ON b.doc_id = a.doc_id + 50"""
)
def q_equal_text(spark, sf_dir):
    a = items(spark, sf_dir).select("doc_id", F.col("item").alias("a"))
    b = items(spark, sf_dir).select((F.col("doc_id") - 50).alias("doc_id"), F.col("item").alias("b"))
    return a.join(b, "doc_id").select("doc_id", text.equal_text(F.col("a"), F.col("b")).alias("same"))


@query(f"""WITH {ITEMS} SELECT a.doc_id, a.uk IS NOT DISTINCT FROM b.text OR (CASE WHEN a.en_set THEN a.uk END) IS NOT DISTINCT FROM b.text AS hit
FROM i a JOIN documents b ON b.doc_id = a.doc_id + 1""")
def q_match_text(spark, sf_dir):
    """Whether the next document's text is a document's text or its translation."""
    after = table(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("asked"))
    return items(spark, sf_dir).join(after, "doc_id").select("doc_id", text.match_text(F.col("item"), F.col("asked")).alias("hit"))


@query(
    r"""SELECT p_partkey, regexp_full_match(v, '\s*[0-9]+([–-][0-9]+)?\s*') AS numeric_text, regexp_full_match(v, '[\x00-\x7F]*') AS ascii_text
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' ' || p_size || chr(9) WHEN 1 THEN p_size || '–' || p_size WHEN 2 THEN p_brand WHEN 3 THEN 'é' || p_size ELSE '' END AS v FROM part)"""
)
def q_is_numeric(spark, sf_dir):
    """Numbers and ranges, and ASCII texts, among names of parts."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    v = (
        F.when(k == 0, F.concat(F.lit(" "), size, F.lit("\t")))
        .when(k == 1, F.concat(size, F.lit("–"), size))
        .when(k == 2, F.col("p_brand"))
        .when(k == 3, F.concat(F.lit("é"), size))
        .otherwise("")
    )
    return table(spark, sf_dir, "part").select("p_partkey", text.is_numeric(v).alias("numeric_text"), text.is_ascii(v).alias("ascii_text"))


@query(f"WITH {ITEMS} SELECT doc_id, NOT en_set AS needed FROM i")
def q_needs_translation(spark, sf_dir):
    return items(spark, sf_dir).select("doc_id", text.needs_translation(F.col("item")).alias("needed"))


@query(f"WITH {ITEMS} SELECT lang, count(*) FILTER (NOT en_set) AS untranslated, count(*) AS total FROM i GROUP BY lang")
def q_untranslated_count(spark, sf_dir):
    needed = text.needs_translation(F.col("item"))
    return items(spark, sf_dir).groupBy("lang").agg(F.count(F.when(needed, 1)).alias("untranslated"), F.count("*").alias("total"))


@query("SELECT conv_id, CAST(floor(turn / 3.0) AS INTEGER) AS batch, count(*) AS turns, min(turn) AS first_turn FROM conversations GROUP BY ALL")
def q_chunks(spark, sf_dir):
    """Turns in batches of three, the last one short."""
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id", text.chunk(F.col("turn"), 3).alias("batch")).agg(F.count("*").alias("turns"), F.min("turn").alias("first_turn"))


@query(
    r"""SELECT doc_id, regexp_replace(doc_id || '. ' || text, '^\pN+\pP?\p{Zs}*', '') AS shown, substr(source, 1, 3) || '...' AS hidden FROM documents"""
)
def q_desc_strip_number(spark, sf_dir):
    """Descriptions without the number in front, and names that are hidden after three characters."""
    numbered = F.concat(F.col("doc_id").cast("string"), F.lit(". "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_number(numbered).alias("shown"), text.redact(F.col("source")).alias("hidden"))


SPELT = f"translate(text, '{''.join(text.LETTERS)}', '{''.join(text.LETTERS.values())}')"
for _letter, _spelt in text.CLUSTERS.items():
    SPELT = f"replace({SPELT}, '{_letter}', '{_spelt.replace(chr(39), chr(39) * 2)}')"


@query(
    f"""SELECT doc_id, CASE WHEN f = '' THEN 'download' ELSE f END AS filename FROM (SELECT doc_id, regexp_replace(replace({SPELT}, '-_', ''), '[^A-Za-z0-9_.-]', '_', 'g') AS f FROM documents)"""
)
def q_ascii_filename(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.ascii_filename(F.col("text")).alias("filename"))


@query("SELECT doc_id, regexp_matches(lower(text), 'idiot|moron|trash|password') AS hit FROM documents")
def q_keyword_scan(spark, sf_dir):
    words = ["idiot", "moron", "trash", "password"]
    return table(spark, sf_dir, "documents").select("doc_id", text.has_keyword(F.col("text"), words).alias("hit"))


@query(
    r"""WITH y AS (SELECT doc_id, text AS s, list_filter(regexp_extract_all(' ' || regexp_replace(text, '([^0-9])', '\1\1', 'g') || ' ', '[^0-9]([0-9]{4})[^0-9]', 1), lambda x: CAST(x AS INTEGER) BETWEEN 1500 AND 2029) AS years FROM documents)
SELECT doc_id, CASE WHEN regexp_extract(s, '([0-9]{4}\s*[-–]\s*[0-9]{4})', 1) <> '' THEN regexp_extract(s, '([0-9]{4}\s*[-–]\s*[0-9]{4})', 1) ELSE coalesce(years[1], '') END AS years FROM y"""
)
def q_year_range(spark, sf_dir):
    """Years and ranges of years in texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.year_range(F.col("text")).alias("years"))


@query(r"SELECT page_id, regexp_extract(url, '\.([^.]+)$', 1) AS suffix FROM pages")
def q_suffix(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.suffix(F.col("url")).alias("suffix"))


@query(
    """SELECT c_custkey, 'f' || c_nationkey AS fond, 'o' || c_custkey AS opus, lower(c_mktsegment) AS description FROM customer"""
)
def q_parse_item(spark, sf_dir):
    """Fond, opus and quoted description out of one text with typographic quotes."""
    line = F.concat(F.lit("f"), F.col("c_nationkey"), F.lit(", o"), F.col("c_custkey"), F.lit(" “"), F.lower("c_mktsegment"), F.lit("”"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.parse_item(line).alias("p")).select("c_custkey", "p.*")


@query("""SELECT doc_id, replace(replace(text, '“', '"'), '”', '"') AS fixed FROM documents""")
def q_fix_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.straight_quotes(F.col("text")).alias("fixed"))
