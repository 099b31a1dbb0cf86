"""Text functions as Catalyst expressions: nothing here leaves the JVM."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Character classes.  Ideographs make CJK tokens; the estimate also counts kana and hangul.
IDEOGRAPH = "[㐀-䶿一-鿿豈-﫿]"
WIDE = "[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]"
DOMINANT = "[㐀-鿿]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]+"
# Fixed value: marks of citation and editing in copied articles, like [12] or [note 3].
CITATION_MARK = (
    r"(?i)\[\s*(?:\d{1,4}|citation needed|clarification needed|verification needed|page needed|note\s*\d*|nb\s*\d*|dead link|sic|update|edit"
    r"|by whom|according to whom|when|who|why|where)\??\s*\]"
)
# What a heading of a Chinese book looks like, its greatest length, and what it doesn't end with.
_NUMERAL = "〇零一二三四五六七八九十百千0-9"
HEADING = (
    rf"^((?:第[{_NUMERAL}]+[章节節回卷篇部集])|(?:卷(?:之)?[{_NUMERAL}]+)|(?:[上中下]卷)|(?:[{_NUMERAL}]+[、.．]\s*\S{{0,20}})"
    r"|(?:序|自序|原序|跋|后记|後記|目录|目錄|凡例|附录|附錄|总论|總論))\s*\S{0,24}$"
)
HEADING_LENGTH, NO_HEADING_END = 32, "[。，；：、.,;]$"
# Glyphs that never fold, and old forms beyond the simplification table.
PROTECTED = "乾"
OLD_FORMS = {"巻": "卷", "歳": "岁", "冩": "写", "毎": "每"}
# Phrases that frame a question, in the order they are stripped.
FRAMING = (
    "请问", "请", "帮我", "我想知道", "告诉我", "解释一下", "介绍一下", "什么是", "如何", "怎样", "怎么", "为什么", "是什么",
    "what is", "how to", "how do i", "tell me about", "explain",
)
QUESTION_TAIL = "[?？。！!]+$"
SEPARATOR = r"[,，;；]|(?:\s+and\s+)|(?:\s*以及\s*)|(?:\s*并且\s*)"


def lit(x) -> Column:
    return F.lit(x)


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    An expression that stands inside a lambda is evaluated for every element;
    as the only element of an array it becomes a variable.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_text(c: Column) -> Column:
    """One kind of line end, runs of blanks as one space, at most one empty line, stripped."""
    c = F.regexp_replace(F.regexp_replace(c, "\r\n|\r", "\n"), "[ \t　]+", " ")
    return F.regexp_replace(F.regexp_replace(c, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """(from, to): traditional glyphs and their simplified forms, one to one, from the ICU data in the running JVM."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("folding needs a running session")
    glyphs = [chr(o) for low, high in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)) for o in range(low, high + 1)]
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    folded = icu.transliterate("\n".join(glyphs)).split("\n")
    table = {a: b for a, b in zip(glyphs, folded) if a != b and len(b) == 1 and a not in PROTECTED} | OLD_FORMS
    return "".join(table), "".join(table.values())


def fold(c: Column) -> Column:
    """Traditional glyphs as simplified ones; keeps the length, so offsets stay valid."""
    return F.translate(c, *fold_table())


def segments(c: Column, folded: bool = False) -> Column:
    """Lower-cased stretches of word characters."""
    return F.filter(F.split(F.lower(fold(c) if folded else c), NOT_WORD), lambda s: s != "")


def tokens(c: Column, folded: bool = False) -> Column:
    """Lower-cased words; a segment with an ideograph gives all its characters, then all their pairs."""

    def spread(segment: Column) -> Column:
        n = F.length(segment)
        one = F.transform(F.sequence(lit(1), n), lambda i: F.substring(segment, i, lit(1)))
        two = F.when(n > 1, F.transform(F.sequence(lit(1), n - 1), lambda i: F.substring(segment, i, lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.when(segment.rlike(IDEOGRAPH), F.concat(one, two)).otherwise(F.array(segment))

    return F.coalesce(F.flatten(F.transform(segments(c, folded), spread)), F.array().cast("array<string>"))


def tokens_sql(x: str) -> str:
    """DuckDB's expression for the unfolded ``tokens`` of an expression."""
    segments = rf"list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda g: g <> '')"
    one = "list_transform(range(1, length(g) + 1), lambda i: substr(g, i, 1))"
    two = "list_transform(range(1, length(g)), lambda i: substr(g, i, 2))"
    return f"flatten(list_transform({segments}, lambda g: CASE WHEN regexp_matches(g, '{IDEOGRAPH}') THEN list_concat({one}, {two}) ELSE [g] END))"


def analyze(c: Column, folded: bool = False) -> Column:
    """Tokens joined by spaces, as an index stores them."""
    return F.array_join(tokens(c, folded), " ")


def matches(c: Column, pattern: str) -> Column:
    """How many characters of ``c`` match a one-character pattern."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def token_estimate(c: Column) -> Column:
    """A wide character counts one token, four others count one; at least 1 for any text, 0 for none."""
    wide = matches(c, WIDE)
    value = F.greatest(F.floor(wide + (F.length(c) - wide) / 4), lit(1))
    return F.when(F.coalesce(F.length(c), lit(0)) == 0, lit(0)).otherwise(value).cast("int")


def chars_for_tokens(budget: int, c: Column) -> Column:
    """The number of characters of a script mix like that of ``c`` that make ``budget`` tokens, at least 1."""
    ratio = token_estimate(c) / F.length(c)
    return F.when(F.coalesce(F.length(c), lit(0)) == 0, lit(budget)).otherwise(F.greatest(F.floor(lit(budget) / ratio), lit(1))).cast("int")


def is_heading(line: Column) -> Column:
    """Whether a stripped line is the heading of a chapter."""
    return F.length(line).between(1, HEADING_LENGTH) & ~line.rlike(NO_HEADING_END) & line.rlike(HEADING)


def promote_headings(c: Column) -> Column:
    """Headings of Chinese books as second-level Markdown headings, all lines stripped, unless the text has Markdown ones."""
    line = lambda x: F.regexp_replace(x, r"^[\s　]+|[\s　]+$", "")
    mark = lambda x: F.when(is_heading(x), F.concat(lit("## "), x)).otherwise(x)
    promoted = F.array_join(F.transform(F.transform(F.split(c, "\n"), line), mark), "\n")
    return F.when(c.rlike(r"(?m)^#{1,6}\s+\S"), c).otherwise(promoted)


def sentences(c: Column) -> Column:
    """Parts that end with a terminator (kept) or a line end; the ASCII full stop is none."""
    return F.filter(F.split(c, r"(?<=[。！？；!?;\n])"), lambda s: s != "")


def guess_language(c: Column) -> Column:
    """zh above a share of 0.15 ideographs in the first 2,000 characters, else en; unknown for no text."""
    head = F.substring(c, 1, 2000)
    share = matches(head, "[一-鿿]") / F.length(head)
    return F.when(F.coalesce(F.length(head), lit(0)) == 0, "unknown").when(share > 0.15, "zh").otherwise("en")


def effective_characters(c: Column) -> Column:
    """Characters that are neither white space nor punctuation."""
    return F.length(F.regexp_replace(c, r"[\s\p{P}\p{Z}]", ""))


def word_share(c: Column) -> Column:
    """Share of word characters; 0 for no text."""
    return F.when(F.length(c) > 0, matches(c, WORD) / F.length(c)).otherwise(lit(0.0))


def cjk_dominant(c: Column) -> Column:
    """Whether at least half of what isn't white space is ideographs."""
    solid = F.regexp_replace(c, r"\s", "")
    return F.coalesce(F.when(F.length(solid) > 0, matches(solid, DOMINANT) / F.length(solid) >= 0.5), lit(False))


def rewrite(c: Column, most: int = 3) -> Column:
    """A query first as it is, then without framing, then its parts; distinct, at most ``most``; blank gives none."""
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    original = strip(c)
    bare = strip(F.regexp_replace(original, QUESTION_TAIL, ""))

    def unframe(c: Column, phrase: Column) -> Column:
        rest = F.regexp_replace(F.substring(c, F.length(phrase) + 1, F.length(c)), "^[的 　]+|[的 　]+$", "")
        return F.when(F.startswith(F.lower(c), phrase), rest).otherwise(c)

    # A fold over the phrases: nesting the expression would double it with each.
    core = F.aggregate(F.array(*map(lit, FRAMING)), bare, unframe)
    variants = F.concat(F.array(original, core), F.transform(F.split(core, SEPARATOR), strip))
    kept = F.filter(variants, lambda v: (v == original) | (F.length(v) >= 2))
    return F.when(F.coalesce(original, lit("")) == "", F.array().cast("array<string>")).otherwise(F.slice(F.array_distinct(kept), 1, most))


def source_anchor(uri: Column, page: Column) -> Column:
    """A citation's address with its page."""
    return F.when((F.coalesce(uri, lit("")) == "") | (F.coalesce(page, lit(0)) == 0), uri).otherwise(
        F.concat(uri, F.when(uri.contains("#"), "&").otherwise("#"), lit("page="), page.cast("string"))
    )


def mime_type(path: Column) -> Column:
    """By extension; octet-stream where it is unknown."""
    table = {
        "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html",
        "pdf": "application/pdf", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
        "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    }
    found = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    result = lit("application/octet-stream")
    for extension, mime in table.items():
        result = F.when(found == extension, mime).otherwise(result)
    return result


def title_from(filename: Column, text: Column) -> Column:
    """The file's name without a text suffix, else the first line that isn't blank, 120 characters at most."""
    stem = F.regexp_replace(F.regexp_extract(filename, r"([^/\\]*)$", 1), r"(?i)\.(txt|md|markdown|text)$", "")
    line = F.regexp_extract(text, r"(?md)^\s*(\S.*?)\s*$", 1)
    return F.when(F.coalesce(stem, lit("")) != "", stem).otherwise(F.substring(F.coalesce(line, lit("")), 1, 120))


def snippet_start(text: Column, terms: Column, width: int) -> Column:
    """0-based start of the first window, stepped by a quarter of its width, with most occurrences of the terms."""
    step = max(width // 4, 1)

    def best(x: Column) -> Column:
        t, words = x["text"], x["terms"]
        starts = F.sequence(lit(0), F.greatest(F.length(t) - width, lit(0)), lit(step))

        def hits(window: Column) -> Column:
            counts = F.transform(words, lambda w: ((F.length(window) - F.length(F.replace(window, w, lit("")))) / F.length(w)).cast("int"))
            return F.aggregate(counts, lit(0), lambda a, n: a + n)

        scored = F.transform(starts, lambda i: F.struct(bind(F.substring(t, i + 1, lit(width)), hits).alias("hits"), (-i).alias("at")))
        return F.when(F.length(t) <= width, lit(0)).otherwise(-F.array_max(scored)["at"])

    return bind(F.struct(text.alias("text"), terms.alias("terms")), best)


def snippet(text: Column, terms: Column, width: int) -> Column:
    """The window with ellipses where text was left out."""

    def cut(x: Column) -> Column:
        start, t = x["start"], x["text"]
        return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(t, start + 1, lit(width)), F.when(start + width < F.length(t), "…").otherwise(""))

    return bind(F.struct(snippet_start(text, terms, width).alias("start"), text.alias("text")), cut)
