"""Text expressions: cleaning, normalising, tokens, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.markup import article, unescape

def clean_html(text: Column) -> Column:
    """Twice unescape and strip tags, since markup may be escaped itself; collapse white space; empty is null."""
    for _ in range(2):
        text = F.regexp_replace(unescape(text), "<[^>]*>", " ")
    return F.nullif(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(""))


# Headings of references; how a line begins that is taken for a heading.
REFERENCES = ("references", "literature cited", "bibliography")
HEADING = r"[A-Z0-9][^a-z]{0,3}\s"


def clean_jats(text: Column) -> Column:
    """Article XML to the text of its abstract and body, in paragraphs, without what follows its last references heading."""
    return strip(trim_references(F.regexp_replace(article(text), r"[ \t]+", " ")))


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def dehyphenate(text: Column) -> Column:
    """Words that a line break cuts, in one piece."""
    return F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")


def trim_references(text: Column) -> Column:
    """Text before the last references heading that stands alone on a line."""
    heading = rf"(?is)^(.*)\n\s*(?:{'|'.join(REFERENCES)})\s*\n"
    return F.when(F.regexp_like(text, F.lit(heading)), F.regexp_extract(text, heading, 1)).otherwise(text)


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, and before lines that begin like headings."""
    return F.filter(F.transform(F.split(text, rf"\n{{2,}}|\n(?={HEADING})"), strip), lambda p: p != "")


def cased_words(text: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def words(text: Column) -> Column:
    """Lower-case runs without white space."""
    return cased_words(F.lower(text))


def norm_match(text: Column) -> Column:
    """Lower case, hyphens and separators as spaces, single spaces."""
    text = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[/|,;:]+", " "), r"\s+", " "))


def occurrences(text: Column, keyword: Column | str) -> Column:
    """Occurrences of a keyword that do not overlap."""
    keyword = F.lit(keyword) if isinstance(keyword, str) else keyword
    return ((F.length(text) - F.length(F.replace(text, keyword, F.lit("")))) / F.length(keyword)).cast("int")


def slug(text: Column, most: int = 120, join: str = "_") -> Column:
    """Letters and digits; anything else becomes the joint, not at the ends."""
    return F.substring(F.btrim(F.regexp_replace(text, "[^A-Za-z0-9]+", join), F.lit(join)), 1, most)


def year_of(text: Column) -> Column:
    """The first year from 1900 to 2099."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d\d)\b", 1), F.lit("")).cast("int")


def url_of(text: Column) -> Column:
    """The first URL, without the punctuation that ends a sentence."""
    return F.nullif(F.rtrim(F.regexp_extract(text, r"https?://\S+", 0), F.lit(".,);")), F.lit(""))


def title_of(text: Column, n: int = 12) -> Column:
    """The first n words, with an ellipsis if there are more."""
    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(parts, 1, n), " "), F.when(F.size(parts) > n, "…").otherwise(""))


def pieces(text: Column, size: int = 24) -> Column:
    """Consecutive pieces of fixed width."""
    count = F.ceil(F.length(text) / size).cast("int")
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def ellipsis(text: Column, most: int = 22, keep: int = 20) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, keep), F.lit("…"))).otherwise(text)


def joined(values: Column) -> Column:
    """The filled parts of an array, or the values of a map, as one text."""
    return F.nullif(F.array_join(F.filter(F.transform(values, lambda v: F.trim(v.cast("string"))), lambda v: v != ""), "; "), F.lit(""))


def embedded(text: Column, most: int = 7000) -> Column:
    """What of a text goes into an embedding; null counts as empty."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def strip_leaks(text: Column) -> Column:
    """Text without leaked tool markup and code fences."""
    text = F.regexp_replace(text, r"(?is)<(tool_call|function_call|think)\b[^>]*>.*?</\1>", "")
    text = F.regexp_replace(text, r"(?s)```.*?```", "")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))


# Marks before a line, numbers before an item, emphasis, what ends a sentence, characters around one.
LINE_MARK, ITEM_NUMBER, EMPHASIS, SENTENCE_END, AROUND = r"^\s*[#>*•\-]+\s*", r"^\s*\d{1,2}[.)]\s+", "**", ".!?;", " -*•\t"


def sentences(text: Column) -> Column:
    """Sentences and list items, without heading, bullet and numbering marks."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.replace(F.regexp_replace(F.regexp_replace(x, LINE_MARK, ""), ITEM_NUMBER, ""), F.lit(EMPHASIS), F.lit("")))
    parts = F.split(F.array_join(lines, "\n"), rf"(?<=[{SENTENCE_END}])\s+|\n+")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(AROUND))), lambda p: p != "")


def inverted_to_text(postings: Column) -> Column:
    """Text of an inverted index (array of (word, positions)): words in order of position."""
    flat = F.flatten(F.transform(postings, lambda p: F.transform(p["positions"], lambda i: F.struct(i.alias("i"), p["word"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(flat), lambda x: x["w"]), " ")
