"""Column functions on text: line ends, white space, language, sentences, noise, markers. All stay in the JVM but the likeness by blocks."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: What ends a line, Unicode's mandatory breaks and the ASCII separators.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Patterns of words, numbers, sentences and paragraphs.
CJK = "[㐀-䶿一-鿿豈-﫿]"
WORD = r"[A-Za-z][A-Za-z'\-]*"
NUMBER = r"(?U)\d+(?:\.\d+)?"
SENTENCE_END = r"(?U)[。！？!?\.]+\s*|[\r\n]{2,}"
PARAGRAPH_END = r"(?U)\n\s*\n+"
#: English words that term frequencies leave out.
STOP_WORDS = tuple(
    """the a an and or but if then of to in on at for with by from as is are was were be been being have has had do does
    did will would could should may might shall can this that these those it its i you he she we they them his her our
    their not no so than such into out up down off over under about above below between through all any some more most
    other same too""".split()
)


#: White space of any script, and the four information separators.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def lines(text: Column) -> Column:
    """Lines of a text; no empty line after a final line end, no line in an empty text."""
    ended = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    # as the one element of an array, so that the text is split once
    return F.element_at(F.transform(F.array(F.split(text, LINE_END, -1)), ended), 1)


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(text, F.lit(WHITE))


def blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def char_classes(text: Column) -> dict[str, Column]:
    """Disjoint classes, the first that fits: CJK, white space, digit, letter, punctuation or symbol, other."""
    # classes are cut against each other with Java's class intersections
    cjk = CJK
    space = r"(?U)[\s\x1c-\x1f]"
    digit = r"[\p{Nd}²³¹⁰-⁹₀-₉①-⑨]"
    letter = rf"[\p{{L}}&&[^㐀-䶿一-鿿豈-﫿]]"
    punct = r"[\p{P}\p{S}]"
    found = {"cjk": cjk, "en_letter": letter, "digit": digit, "punct": punct, "whitespace": space}
    out = {name: count_of(text, pattern) for name, pattern in found.items()}
    out["other"] = F.length(text).cast("long") - sum(out.values(), F.lit(0).cast("long"))
    return out


def filled_parts(text: Column, pattern: str) -> Column:
    """How many parts that aren't blank a split leaves."""
    return F.size(F.filter(F.split(text, pattern, -1), lambda p: ~blank(p))).cast("long")


def text_counts(text: Column) -> dict[str, Column]:
    classes = char_classes(text)
    words = count_of(text, WORD)
    total = F.length(text).cast("long")
    return {
        "char_total": total,
        "char_no_ws": total - classes["whitespace"],
        "cjk_chars": classes["cjk"],
        "en_words": words,
        "numbers": count_of(text, NUMBER),
        "word_total": classes["cjk"] + words,
        "paragraphs": filled_parts(text, PARAGRAPH_END),
        "sentences": filled_parts(text, SENTENCE_END),
        "lines": F.size(F.filter(lines(text), lambda x: ~blank(x))).cast("long"),
    }


def reading_minutes(cjk: Column, words: Column) -> Column:
    """Minutes at 300 characters and 200 words a minute, one decimal, halves to even."""
    return F.bround(cjk.cast("decimal(20,6)") / 300 + words.cast("decimal(20,6)") / 200, 1).cast("double")


def guess_language(text: Column) -> Column:
    """zh if over 30 % of the letters of the first 2000 characters are CJK, auto without letters, else en."""
    head = F.substring(text, 1, 2000)
    cjk = F.regexp_count(head, F.lit("[一-鿿]"))
    letters = F.regexp_count(head, F.lit(r"\p{L}"))
    return F.when(letters == 0, "auto").when(cjk > 0.3 * letters, "zh").otherwise("en")


#: Characters that hint at a script, and the length of the sample.
CJK_CHARACTER = "[㐀-鿿가-힯぀-ヿ]"
JAPANESE_HINT = "[぀-ゟ゠-ヿ]"
TRADITIONAL_HINT = "[ㄅ-ㄯ的是不為這個]"
SIMPLIFIED_HINT = "[这为么会个时间]"
LANGUAGE_SAMPLE = 5000


def script_language(text: Column) -> Column:
    """ja, zh-Hant, zh-Hans or en by the scripts of the first 5000 characters; unknown for null or empty texts."""
    sample = F.left(text, F.lit(LANGUAGE_SAMPLE))
    n = F.length(sample)
    cjk, japanese, traditional, simplified = (F.regexp_count(sample, F.lit(p)) for p in (CJK_CHARACTER, JAPANESE_HINT, TRADITIONAL_HINT, SIMPLIFIED_HINT))
    some = cjk * 10 > n
    return F.when(F.coalesce(n, F.lit(0)) == 0, "unknown").when(some & (japanese * 20 > n), "ja").when(some & (traditional >= simplified), "zh-Hant").when(some, "zh-Hans").otherwise("en")


def sentences(text: Column) -> Column:
    """Sentences of running text, cut behind end marks and at line breaks; blank ones left out."""
    cut = r"(?U)(?<=[.!?。！？])\s+|(?<=[。！？])(?=[A-Z一-鿿])|\n+"
    return F.filter(F.transform(F.split(text, cut, -1), strip), lambda s: s != "")


def noisy(text: Column) -> Column:
    """Text of a broken character map: many Latin extras, control or private characters, or hardly a vowel."""
    n = F.greatest(F.length(text), F.lit(1))
    extra = F.regexp_count(text, F.lit("[\u00c0-\u024f]"))
    control = F.regexp_count(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f\ue000-\uf8ff]"))
    letters = F.regexp_count(text, F.lit("[A-Za-z]"))
    vowels = F.regexp_count(text, F.lit("[AEIOUaeiou]"))
    cjk = F.regexp_count(text, F.lit("[一-鿿]"))
    return ((extra >= 5) & (extra > 0.1 * n)) | (control > 0.2 * n) | ((letters >= 8) & (vowels < 0.12 * letters) & (cjk == 0))


def clean(text: Column) -> Column:
    """Without private and control characters; empty if what is left is noise."""
    kept = F.regexp_replace(text, "[\ue000-\uf8ff\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]", "")
    return F.when(noisy(kept), "").otherwise(kept)


#: Blocks whose signs hardly stand in running text: operators, technical signs, boxes, shapes, symbols, dingbats,
#: phonetic signs, letters of syllables, private characters; and rare ideographs.
ODD_SIGNS = r"[\u2200-\u23ff\u2500-\u257f\u25a0-\u27bf\u3100-\u318f\ue000-\uf8ff]"
RARE_IDEOGRAPHS, IDEOGRAPHS = r"[\u3400-\u4dbf\x{20000}-\x{2ffff}]", r"[\u3400-\u9fff\x{20000}-\x{2ffff}]"


def garbled(text: Column) -> Column:
    """Text of a font with a wrong character map: odd signs, alone in a short text or a quarter of all; a letter or digit eight
    times in a row; a short cycle with a letter or digit four times in a row. Null and empty text isn't garbled."""
    rare = count_of(text, RARE_IDEOGRAPHS)
    odd = count_of(text, ODD_SIGNS) + rare
    signs = count_of(text, IDEOGRAPHS) + odd
    cycle = F.regexp_extract(text, r"(.{2,4})\1{3,}", 1)
    found = ((odd >= 1) & (signs <= 12)) | (odd >= 0.25 * F.greatest(signs, F.lit(1))) | text.rlike(r"([A-Za-z0-9])\1{7,}") | cycle.rlike("[A-Za-z0-9]")
    return F.coalesce(found & (text != ""), F.lit(False))


def keep_as_is(line: Column) -> Column:
    """Lines that aren't translated: filler, fences, rules, lone marks, tags, addresses, table rules."""
    s = strip(line)
    return (
        (s == "")
        | s.rlike(r"^[.\-_=*~·…\s]+$")
        | s.rlike(r"^(```|~~~)")
        | s.rlike(r"^[#>*+\-|]+$")
        | s.rlike(r"^</?[A-Za-z][^>]*>$")
        | s.rlike(r"^https?://\S+$")
        | s.rlike(r"^\|?[\s:\-|]+\|?$")
    )


def footer_like(line: Column) -> Column:
    """At most 80 characters with two or more of phone, mail, business id and page number."""
    marks = [r"(?i)(tel|phone|fax|電話|傳真)|\d{2,4}-\d{3,4}-?\d{3,4}", r"[\w.+\-]+@[\w\-]+\.[\w.\-]+", r"(統一編號|統編)|(?<!\d)\d{8}(?!\d)", r"(?i)(page|第)\s*\d+|^\s*-?\s*\d+\s*-?\s*$"]
    return (F.length(line) <= 80) & (sum((line.rlike(m).cast("int") for m in marks), F.lit(0)) >= 2)


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def natural_key(line: Column) -> Column:
    """An array that sorts digit runs by value, before text; text without case."""
    runs = F.regexp_extract_all(F.lower(line), F.lit("[0-9]+|[^0-9]+"), 0)
    return F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.ltrim(r, F.lit("0")), 40, "0"))).otherwise(F.concat(F.lit("1"), r)))


def display_width(text: Column) -> Column:
    """Columns on a terminal: wide characters take two."""
    return F.length(text) + F.regexp_count(text, F.lit("[\u1100-\u115f\u2e80-\u303e\u3041-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6]"))


def spreadsheet_safe(value: Column) -> Column:
    """A quote before what a spreadsheet would run as a formula; null is empty; applied twice it changes nothing more."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)


def xml_escape(value: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        value = F.replace(value, F.lit(plain), F.lit(safe))
    return value


def markdown_escape(value: Column) -> Column:
    return F.regexp_replace(F.replace(value, F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ")


def title_case(text: Column) -> Column:
    """Every letter behind a non-letter in upper case, the rest in lower case (apostrophes and digits start anew)."""
    marked = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(marked, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2**31 - 1))), "")


def city_of(address: Column) -> Column:
    """The city or county at the start of an address, variants folded, else 其他."""
    found = F.regexp_extract(F.translate(address, "臺", "台"), r"^\s*(.{1,3}?[縣市])", 1)
    return F.when(found == "", "其他").otherwise(found)


def list_marker(line: Column) -> Column:
    """Kind of the list marker a line starts with, the first that fits, else null."""
    kinds = (
        ("checkbox", r"^\s*[-*]?\s*[\[［][ xX✓]?[\]］]"),
        ("bullet", r"^\s*[•●○■□◆◇▪▫‣⁃*\-–—]\s+"),
        ("article", r"^\s*第[一二三四五六七八九十百0-9]+[條章節項款]"),
        ("cjk_number", r"^\s*[一二三四五六七八九十]+[、.．]"),
        ("cjk_paren", r"^\s*[(（][一二三四五六七八九十]+[)）]"),
        ("paren_number", r"^\s*[(（]?\d{1,3}[)）]"),
        ("decimal", r"^\s*\d+(?:\.\d+)+\s"),
        ("number", r"^\s*\d{1,3}[.、．]\s*"),
        ("roman", r"^\s*(?:[IVX]+|[ivx]+)[.)]\s"),
        ("letter", r"^\s*[A-Za-z][.)]\s"),
        ("quote", r"^\s*>\s"),
        ("heading", r"^\s*#{1,6}\s"),
    )
    out = F.lit(None).cast("string")
    for name, pattern in reversed(kinds):
        out = F.when(line.rlike(pattern), name).otherwise(out)
    return out


#: Fixed values: (name, style, expression) of list markers, the first that fits; the last group is the body.
LIST_PATTERNS = (
    ("arabic_dot", "List Number", r"^(\d+)\.\s+(.+)"),
    ("arabic_paren", "List Number", r"^\((\d+)\)\s+(.+)"),
    ("arabic_paren_f", "List Number", r"^([(（])(\d+)([)）])\s*(.+)"),
    ("cn_num_comma", "List Number", r"^([一二三四五六七八九十]+)、\s*(.+)"),
    ("cn_num_dot", "List Number", r"^([一二三四五六七八九十]+)\.\s*(.+)"),
    ("cn_num_paren", "List Number", r"^[(（]([一二三四五六七八九十]+)[)）]\s*(.+)"),
    ("cn_top", "List Number", r"^([壹貳參肆伍陸柒捌玖拾]+)、\s*(.+)"),
    ("bullet_dash", "List Bullet", r"^[-–]\s+(.+)"),
    ("bullet_star", "List Bullet", r"^\*\s+(.+)"),
    ("bullet_dot", "List Bullet", r"^[•‧·▪◆■□◇○●]\s*(.+)"),
    ("alpha_lower_paren", "List Number", r"^\(([a-z])\)\s+(.+)"),
    ("alpha_upper_paren", "List Number", r"^\(([A-Z])\)\s+(.+)"),
    ("alpha_lower_dot", "List Number", r"^([a-z])\.\s+(.+)"),
    ("roman_lower", "List Number", r"(?i)^(i{1,3}|iv|v|vi{1,3}|ix|x{1,3})\.\s+(.+)"),
    ("roman_upper_paren", "List Number", r"^\((I{1,3}|IV|V|VI{1,3}|IX|X{1,3})\)\s+(.+)"),
    ("dash_em", "List Bullet", r"^—\s+(.+)"),
    ("multi_level", "List Number", r"^(\d+(?:\.\d+){1,3})\.?\s+(.+)"),
    ("ch_chapter", "List Number", r"^(第\s*[0-9一二三四五六七八九十百零兩]+\s*[章節條項款目])\s*(.+)"),
)


def list_item(line: Column) -> Column:
    """(name, style, body) of a list item; null for other lines."""
    out = F.lit(None).cast("struct<name:string,style:string,body:string>")
    for name, style, pattern in reversed(LIST_PATTERNS):
        body = F.regexp_extract(line, pattern, re.compile(pattern).groups)
        out = F.when(line.rlike(pattern), F.struct(F.lit(name).alias("name"), F.lit(style).alias("style"), body.alias("body"))).otherwise(out)
    return out


def without_zero_width(text: Column) -> Column:
    """Without byte order marks and zero-width characters, white space folded to single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[\ufeff\u200b\u200c\u200d]", ""), r"(?U)\s+", " "))


def safe_file_name(name: Column, fallback: str = "list") -> Column:
    """A file name without extension and without what file systems forbid, at most 80 characters."""
    base = F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))
    base = F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    return F.coalesce(F.nullif(F.left(F.regexp_replace(base, r'[\\/:*?"<>|]', "_"), F.lit(80)), F.lit("")), F.lit(fallback))


#: Fixed value: an absolute path up to its last separator, on either kind of system; and how much of a reason is told.
PATH_HEAD = r"""(?:[A-Za-z]:)?[\\/](?:[^\s'"\\/]+[\\/])+(?:[^\s'"]*[\\/])?"""
REASON_CHARS = 300


def safe_reason(error: Column) -> Column:
    """An error's message as it may leave the system: its first characters, absolute paths cut to their file names."""
    told = F.left(F.coalesce(error, F.lit("")), F.lit(REASON_CHARS))
    told = F.regexp_replace(told, PATH_HEAD + r"""(?=[\s'"]|$)""", "檔案")
    return F.regexp_replace(told, PATH_HEAD + r"""([^\s'"\\/]+)""", "$1")


def joined_cjk(text: Column) -> Column:
    """Without spaces between CJK characters, but for the blanks of dates and times on forms (年 月 日, 時 分)."""
    return F.regexp_replace(text, r"(?<=[一-鿿])(?<![年月時])[ \u3000]+(?=[一-鿿])|(?<=[年月時])[ \u3000]+(?=[一-鿿&&[^月日分]])", "")


def toc_entry(line: Column) -> Column:
    """(title, page, level) of a line of contents: its last number, leaders cut off; two spaces of indent are a level."""
    found = r"^(.*?)([0-9]+)[\s\u3000]*$"
    cut = F.regexp_replace(line, r"[0-9]+[\s\u3000]*$", "")
    page = F.regexp_extract(line, r"([0-9]+)[\s\u3000]*$", 1)
    indent = F.replace(F.regexp_extract(cut, r"^([\t \u3000]*)", 1), F.lit("\u3000"), F.lit("  "))
    title = F.regexp_replace(strip(cut), r"[ \t.…·\u3000]+$", "")
    fits = line.rlike(found) & (title != "")
    return F.when(fits, F.struct(title.alias("title"), page.try_cast("long").alias("page"), (F.floor(F.length(indent) / 2) + 1).cast("int").alias("level")))


#: Fixed value: the least likeness by matching blocks of texts that count as one with slips.
LIKENESS = 0.92


@F.pandas_udf(BooleanType())
def block_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Do matching blocks cover enough of both texts? Nulls are not compared."""
    pairs = zip(a, b)
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() >= LIKENESS for x, y in pairs], dtype=object)


def closely_equal(expected: Column, actual: Column) -> Column:
    """Equal but for case, space and doubled marks; or expected (3 characters or more) begins actual, or (5 or more) lies in it;
    or, at about one length, matching blocks cover 0.92 of both. Only pairs that nothing else decides reach Python."""
    plain = lambda c: F.lower(F.regexp_replace(F.regexp_replace(strip(c), r"([,.\-_;:])\1+", "$1"), r"(?U)\s+", ""))
    a, b = plain(expected), plain(actual)
    simple = (a == b) | ((F.length(a) >= 3) & b.startswith(a)) | ((F.length(a) >= 5) & b.contains(a))
    open_ = (a != "") & (b != "") & ~simple & (F.abs(F.length(a) - F.length(b)) <= F.greatest(F.lit(4), F.floor(F.length(a) / 5)))
    near = block_alike(F.when(open_, a), F.when(open_, b))
    return F.coalesce((a != "") & (b != "") & (simple | F.coalesce(near, F.lit(False))), F.lit(False))
