import pytest
from pyspark.sql import functions as F

from corpusweave.functions import repair as fx
from corpusweave.functions import text as tx
from corpusweave.operators.formatting import format_fields, python_formatter, repair_fields


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "text string")
    return df.select(fn(F.col("text")).alias("text")).first()["text"]


@pytest.mark.parametrize(
    "fn, given, expected",
    [
        (tx.collapse_whitespace, "  one,   two  \n and \t\t three  ", "one, two and three"),
        (tx.collapse_whitespace, "a  b\u0085c\x1fd", "a b c d"),
        (tx.reverse_words, "Guten  Tag!", "netuG !gaT"),
        (tx.upper, "élève über naïf", "ÉLÈVE ÜBER NAÏF"),
        (tx.newline_to_space, "a\nb\n", "a b "),
        (tx.replace_quotes, 'He said "yes" and "no" and "', 'He said «yes» and «no» and "'),
        (fx.unescape_html, "A &amp; B &lt;3 &#233; &unknown; &amp;amp;", "A & B <3 é &unknown; &"),
        (fx.unescape_html, "one &amp;\n<b> &amp;\n&amp;", "one &\n<b> &amp;\n&amp;"),
        (fx.remove_terminal_escapes, "\x1b[31mred\x1b[0m \x1b[1;32mok", "red ok"),
        (fx.fix_encoding, "cafÃ© & El NiÃ±o", "café & El Niño"),
        (fx.fix_encoding, "cafÃ© und Käse", "café und Käse"),
        (fx.fix_encoding, "donâ€™t", "don’t"),
        (fx.fix_encoding, "Ð¿Ñ€Ð¸Ð²ÐµÑ‚", "привет"),
        (fx.fix_encoding, "CAFÉ» et ÂGE", "CAFÉ» et ÂGE"),
        (fx.fix_encoding, "voilÃ  lÃ ", "voilà là"),
        (fx.fix_encoding, "SÃ£o TomÃ©, Ã¼ber", "São Tomé, über"),
        (fx.fix_encoding, "РџСЂРёРІРµС‚", "Привет"),
        (fx.fix_encoding, "слово РџСЂРёРІРµС‚ éé", "слово Привет éé"),
        (fx.fix_encoding, "Чистый текст, её В° Г—", "Чистый текст, её В° Г—"),
        (fx.fix_encoding, "ĹĽĂłĹ‚w", "żółw"),
        (fx.fix_encoding, "┬½caf├⌐┬╗", "«café»"),
        (fx.unescape_html, "&copyright; &sectional; &copy; &EACUTE;", "&copyright; &sectional; © É"),
        (fx.unescape_html, "&CounterClockwiseContourIntegral; &#x1F600; &#00000000065;", "∳ 😀 A"),
        (fx.fix_c1_controls, "\x93quoted\x94", "“quoted”"),
        (fx.fix_latin_ligatures, "ﬁﬂﬃ Ĳ", "fiflffi IJ"),
        (fx.fix_character_width, "ＬＯＵＤ　ｶﾅ", "LOUD カナ"),
        (fx.uncurl_quotes, "‘a’ “b”", "'a' \"b\""),
        (fx.fix_line_breaks, "a\r\nb\rc d\u0085e", "a\nb\nc\nd\ne"),
        (fx.remove_control_chars, "a\x00b\x07c﻿d\te\nf", "abcd\te\nf"),
    ],
)
def test_string_functions(spark, fn, given, expected):
    assert one(spark, given, fn) == expected


def misread(text, encoding, times=1):
    for _ in range(times):
        text = "".join(fx._char(b, encoding) if b > 127 else chr(b) for b in text.encode())
    return text


@pytest.mark.parametrize(
    "encoding, text",
    [
        ("latin-1", "с и ты в лесу с ним"),
        ("cp1252", "élève à côté, señor"),
        ("cp1251", "Привет, и ты в лесу с ним"),
        ("cp1250", "Zażółć gęślą jaźń"),
        ("cp1253", "καλημέρα κόσμε"),
        ("cp1254", "çok güzel bir gün"),
        ("cp1257", "ąžuolas ir šuo"),
        ("iso8859_2", "Příliš žluťoučký kůň"),
        ("mac_roman", "garçon déjà élevé"),
        ("cp437", "naïve café déjà"),
    ],
)
def test_lines_misread_in_any_encoding(spark, encoding, text):
    given = f"чистая строка, ещё\n{misread(text, encoding)}\nplain\nñandú é"
    assert one(spark, given, fx.fix_encoding) == f"чистая строка, ещё\n{text}\nplain\nñandú é"


@pytest.mark.parametrize("line", ["le café noir", "ein ö, und", "È.", "das ü war", "Über", "ÖL", "año"])
def test_one_letter_misread_as_cyrillic(spark, line):
    assert one(spark, misread(line, "cp1251"), fx.fix_encoding) == line


@pytest.mark.parametrize("line", ["plan «Г»", "Г – X", "дії", "Зі", "Дія in 2 words", "aΓ²", "Г\xa0Moscow", "Її"])
def test_clean_cyrillic_stays(spark, line):
    assert one(spark, line, fx.fix_encoding) == line


def test_cyrillic_query_gives_the_repaired_text(spark, sf_dir, monkeypatch):
    from catalog import repair_queries as queries

    monkeypatch.setattr(queries.fx, "fix_encoding", lambda text: F.concat(text, F.lit("!")))
    assert queries.fix_encoding_cyrillic(spark, sf_dir).where("text not like '%!'").count() == 0


@pytest.mark.parametrize("times", [2, 4, 6])
def test_text_misread_many_times(spark, times):
    assert one(spark, misread("café", "latin-1", times), fx.fix_encoding) == "café"


def test_entities_and_misreading_nested(spark):
    given = misread("a &amp;eacute; ünd ö", "cp1252") + "\n<b>&amp;"
    assert one(spark, given, fx.fix_text) == "a é ünd ö\n<b>&amp;"


@pytest.mark.parametrize(
    "switches, given, expected",
    [
        (
            {},
            "Max &amp; Moritz im cafÃ© bei El NiÃ±o, \x1b[31mrot\x1b[0m.",
            "Max & Moritz im café bei El Niño, rot.",
        ),
        ({"unescape_html": False}, "1 &lt; 2 &amp; 3", "1 &lt; 2 &amp; 3"),
        (
            {"remove_terminal_escapes": False, "remove_control_chars": False},
            "\x1b[32mOK\x1b[0m",
            "\x1b[32mOK\x1b[0m",
        ),
        ({"fix_encoding": False}, "cafÃ©", "cafÃ©"),
        ({"normalization": "NFC"}, "é", "é"),
        ({"normalization": "NFKD"}, "ﬁ é", "fi é"),
        ({}, None, None),
        ({}, "", ""),
    ],
)
def test_fix_text(spark, switches, given, expected):
    assert one(spark, given, lambda t: fx.fix_text(t, **switches)) == expected


def test_unknown_normal_form():
    with pytest.raises(ValueError):
        fx.normalize_unicode(None, "NFX")


def test_fields_are_changed_in_place(spark):
    df = spark.createDataFrame(
        [(1, "a", {"k": "b", "other": "c"})], "id int, text string, metadata map<string,string>"
    )
    done = format_fields(df, tx.upper, ["text", "metadata['k']"])
    assert done.columns == df.columns
    assert done.first().asDict() == {"id": 1, "text": "A", "metadata": {"k": "B", "other": "c"}}


def test_python_formatter_keeps_nulls(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    done = format_fields(df, python_formatter(lambda s: s[::-1]))
    assert {r["text"] for r in done.collect()} == {"b a", None}


def test_repair_fields(spark):
    df = spark.createDataFrame([("cafÃ©", "x &amp; y")], "text string, title string")
    assert tuple(repair_fields(df, ["text", "title"]).first()) == ("café", "x & y")


@pytest.mark.parametrize("encoding", ["latin-1", *fx.OTHER_ENCODINGS])
def test_characters_are_read_as_their_bytes(encoding):
    """Windows-1252 and Latin-1 together; elsewhere undefined bytes are their C1 control."""
    table = fx._LATIN if encoding == "latin-1" else fx._OTHERS[encoding]
    want = {chr(b): b for b in range(0x80)} | {"\ufffd": 0x1A}
    for e in ("latin-1", "cp1252") if encoding == "latin-1" else (encoding,):
        want |= {fx._char(b, e): b for b in range(0x80, 0x100)}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x10100)]):
        raw = fx._as_bytes(c, table)
        assert raw == (bytes([want[c]]) if c in want else None)
    assert fx._as_bytes("\x80" + "".join(want), table) == (
        b"\x80" + bytes(want.values()) if "\x80" in want else None
    )


class Untranslated(str):
    def translate(self, table):
        raise AssertionError("a look-up per character")


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", *fx.OTHER_ENCODINGS])
def test_encoding_is_repaired_without_a_look_up_per_character(encoding):
    line = "Élève, une forêt où çà et là l'été naît, żółw, привет; "
    broken = "".join(fx._char(b, encoding) for b in line.encode())
    assert fx._fix_line_encoding(Untranslated(broken), True, True, True) == line
