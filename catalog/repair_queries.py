"""Text repairs: defects are put into whole texts by expression and must come out again."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query, table
from corpusweave.functions import repair as fx
from corpusweave.operators.formatting import repair_fields
from corpusweave.plans.partitions import spread

ORIGINAL = "SELECT doc_id, text FROM documents"


def damaged(spark, sf_dir, damage):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", damage(F.col("text")).alias("text"))


def repaired(spark, sf_dir, damage, fix):
    return damaged(spark, sf_dir, damage).select("doc_id", fix(F.col("text")).alias("text"))


def misread(text):
    """UTF-8 bytes read as Latin-1."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def swap(text, old, new):
    return F.replace(text, F.lit(old), F.lit(new))


@query(
    """SELECT page_id, replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'),
  '&middot;', '·'), '&amp;', '&') AS html FROM pages"""
)
def unescape_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", fx.unescape_html(F.col("html"), True).alias("html"))


@query(
    """WITH damaged AS (
  SELECT doc_id, replace(replace(replace(text, '&', '&amp;'), 'é', '&eacute;'), 'ü', '&#252;') AS text
  FROM documents), cut AS (
  SELECT doc_id, text, strpos(text, '<') AS tag,
         CASE WHEN strpos(text, '<') = 0 THEN length(text)
              WHEN strpos(reverse(left(text, strpos(text, '<'))), chr(10)) = 0 THEN 0
              ELSE strpos(text, '<') - strpos(reverse(left(text, strpos(text, '<'))), chr(10)) + 1
         END AS head
  FROM damaged)
SELECT doc_id, replace(replace(replace(left(text, head), '&eacute;', 'é'), '&#252;', 'ü'),
                       '&amp;', '&') || substr(text, head + 1) AS text
FROM cut"""
)
def unescape_html_auto(spark, sf_dir):
    return repaired(
        spark,
        sf_dir,
        lambda t: swap(swap(swap(t, "&", "&amp;"), "é", "&eacute;"), "ü", "&#252;"),
        fx.unescape_html,
    )


@query(ORIGINAL)
def remove_terminal_escapes(spark, sf_dir):
    return repaired(
        spark, sf_dir, lambda t: swap(t, " ", "\x1b[31m \x1b[0m"), fx.remove_terminal_escapes
    )


@query(ORIGINAL)
def fix_encoding(spark, sf_dir):
    return repaired(spark, sf_dir, misread, fx.fix_encoding)


@query(
    """SELECT doc_id, replace(text, ', ', ',' || chr(160)) AS text FROM documents"""
)
def restore_byte_a0(spark, sf_dir):
    return repaired(
        spark,
        sf_dir,
        lambda t: swap(misread(swap(t, ", ", ",\xa0")), "\xa0", " "),
        fx.fix_encoding,
    )


@query("SELECT doc_id, replace(text, 'é', chr(65533)) AS text FROM documents")
def replace_lossy_sequences(spark, sf_dir):
    return repaired(
        spark, sf_dir, lambda t: swap(misread(t), "Ã©", "Ã\x1a"), fx.fix_encoding
    )


@query(ORIGINAL)
def decode_inconsistent_utf8(spark, sf_dir):
    """Only some characters were misread, two of them as Windows-1252."""
    return repaired(
        spark,
        sf_dir,
        lambda t: swap(swap(swap(t, "é", "Ã©"), "É", "Ã‰"), "Ñ", "Ã‘"),
        fx.fix_encoding,
    )


@query(ORIGINAL)
def fix_encoding_of_clean_text(spark, sf_dir):
    """What was never misread stays as it is."""
    return repaired(spark, sf_dir, lambda t: t, fx.fix_encoding)


# Characters of the second halves of the Cyrillic code page, by which bytes become text.
CYRILLIC = "".join(fx._char(b, "cp1251") for b in range(0x80, 0x100))


@query(ORIGINAL)
def fix_encoding_cyrillic(spark, sf_dir):
    """UTF-8 bytes read as Windows-1251, in every second line only."""
    high = "".join(map(chr, range(0x80, 0x100)))
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.when(i % 2 == 0, F.translate(misread(line), high, CYRILLIC)).otherwise(line),
    )
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    broken = docs.select("doc_id", F.array_join(lines, "\n").alias("text"))
    return broken.select("doc_id", fx.fix_encoding(F.col("text")).alias("text"))


@query("SELECT doc_id, replace(text, ' ', ' “') AS text FROM documents")
def fix_c1_controls(spark, sf_dir):
    return repaired(spark, sf_dir, lambda t: swap(t, " ", " \x93"), fx.fix_c1_controls)


@query(ORIGINAL)
def fix_latin_ligatures(spark, sf_dir):
    return repaired(
        spark,
        sf_dir,
        lambda t: swap(swap(swap(t, "ff", "ﬀ"), "fi", "ﬁ"), "st", "ﬆ"),
        fx.fix_latin_ligatures,
    )


@query(ORIGINAL)
def fix_character_width(spark, sf_dir):
    plain = "abcdefghijklmnopqrstuvwxyz ,.0123456789"
    wide = "".join("\u3000" if c == " " else chr(ord(c) + 0xFEE0) for c in plain)
    return repaired(
        spark, sf_dir, lambda t: F.translate(t, plain, wide), fx.fix_character_width
    )


@query("""SELECT doc_id, replace(replace(text, ', ', '", "'), 'th', '''th') AS text FROM documents""")
def uncurl_quotes(spark, sf_dir):
    return repaired(
        spark,
        sf_dir,
        lambda t: swap(swap(t, ", ", "”, “"), "th", "‘th"),
        fx.uncurl_quotes,
    )


@query("SELECT doc_id, replace(text, '. ', '.' || chr(10)) AS text FROM documents")
def fix_line_breaks(spark, sf_dir):
    return repaired(
        spark,
        sf_dir,
        lambda t: swap(swap(t, "\n", "\r\n"), ". ", ".\u2028"),
        fx.fix_line_breaks,
    )


@query("SELECT doc_id, chr(65533) || text AS text FROM documents")
def fix_surrogates(spark, sf_dir):
    return repaired(
        spark,
        sf_dir,
        lambda t: F.concat(F.unhex(F.lit("FF")), F.encode(t, "UTF-8")).cast("string"),
        fx.fix_surrogates,
    )


@query(ORIGINAL)
def remove_control_chars(spark, sf_dir):
    return repaired(
        spark, sf_dir, lambda t: swap(t, " ", "\x07 \ufeff"), fx.remove_control_chars
    )


@query(ORIGINAL)
def normalize_unicode(spark, sf_dir):
    return repaired(
        spark,
        sf_dir,
        lambda t: swap(swap(t, "é", "e\u0301"), "ñ", "n\u0303"),
        lambda t: fx.normalize_unicode(t, "NFC"),
    )


@query(ORIGINAL)
def fix_text(spark, sf_dir):
    """All default repairs at once; texts hold no tags, so entities are decoded."""
    broken = damaged(
        spark,
        sf_dir,
        lambda t: swap(swap(misread(t), " ", "\x1b[1m \x1b[0m\x07"), "\n", "&#10;"),
    )
    return repair_fields(broken)
