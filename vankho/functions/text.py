"""Text expressions of the retrieval pipeline: tokens, cleaning, labels, snippets, citations. All are Catalyst expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The letters that legal tokens keep besides a-z and 0-9, and the joints kept inside a token.
LEGAL_LETTERS = "àáảãạăắằẳẵặâấầẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ"
LEGAL_TOKEN = rf"([a-z0-9{LEGAL_LETTERS}/._\-]+)"
#: Headings by level, as regular expressions over a line.
HEADINGS = {
    "chapter": r"^\s*(?:CHƯƠNG|Chương|PHẦN|Phần)\s+[IVXLCDM0-9]+",
    "section": r"^\s*(?:MỤC|Mục)\s+[IVXLCDM0-9]+",
    "article": r"^\s*(?:ĐIỀU|Điều)\s+[0-9]+",
    "clause": r"^\s*[0-9]+\.\s+\S",
    "point": r"^\s*[a-zđ]\)\s+\S",
}
DOC_NUMBER = r"([0-9]{1,4}(?:/[0-9A-ZĐ_a-zđ.\-]+)+)"


def tokens(col: Column, kind: str = "a") -> Column:
    """Lower-case tokens: "a" letters and digits, "b" also underscores, "c" whole document numbers with their joints."""
    text = F.lower(F.coalesce(col, F.lit("")))
    if kind == "c":
        found = F.regexp_extract_all(text, F.lit(LEGAL_TOKEN), 1)
        return F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"^[/._\-]+|[/._\-]+$", "")), lambda t: t != "")
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)" if kind == "a" else r"([\p{L}\p{N}_]+)"), 1)


def clean_text(col: Column) -> Column:
    """Odd blanks to spaces, line ends to one form, at most one blank line in a row, lines trimmed."""
    text = F.regexp_replace(F.regexp_replace(col, "[\\u00a0\\u200b\\t]", " "), "\r\n?", "\n")
    lines = F.transform(F.split(F.regexp_replace(text, "\n{3,}", "\n\n"), "\n", -1), lambda x: F.trim(x))
    return F.trim(F.array_join(lines, "\n"))


def numeric_suffix(col: Column) -> Column:
    """Number after the last colon, else the first number, else 0."""
    return F.coalesce(F.regexp_extract(col, r":[^:0-9]*([0-9]+)$", 1).try_cast("bigint"), F.regexp_extract(col, r"([0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def article_label(col: Column) -> Column:
    """`Điều n` of any text that names an article; the trimmed text otherwise."""
    number = F.regexp_extract(col, r"(?:ĐIỀU|Điều|điều)?\s*([0-9]+[a-z]?)", 1)
    return F.when(number != "", F.concat(F.lit("Điều "), number)).otherwise(F.trim(col))


def article_slug(col: Column) -> Column:
    """`d04` for article 4; doc_fallback where there is none."""
    number = F.regexp_extract(F.coalesce(col, F.lit("")), r"([0-9]+)", 1)
    return F.when(number == "", F.lit("doc_fallback")).otherwise(F.concat(F.lit("d"), F.lpad(number, 2, "0")))


def heading_level(line: Column) -> Column:
    """Level of a heading line; null for any other line."""
    level = None
    for name, pattern in HEADINGS.items():
        level = F.when(line.rlike(pattern), name) if level is None else level.when(line.rlike(pattern), name)
    return level


def references(col: Column) -> Column:
    """Sorted distinct articles and clauses that a text names."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"((?:điều|khoản|chương) [0-9]+)"), 1)
    return F.array_sort(F.array_distinct(found))


def dedup_key(col: Column) -> Column:
    """Lower case, one space for every run of other characters."""
    return F.trim(F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}_]+", " "))


def doc_numbers(col: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(DOC_NUMBER), 1)


def snippet(col: Column, needle: Column, whole: int = 300, around: int = 100) -> Column:
    """The text up to `whole` characters, else `around` characters on both sides of the first match, marked with dots."""
    place = F.call_function("locate", needle, col)
    begin = F.greatest(place - around, F.lit(1))
    end = F.least(place + F.length(needle) + around, F.length(col) + 1)
    cut = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(col, begin, end - begin), F.when(end <= F.length(col), "...").otherwise(""))
    return F.when((F.length(col) <= whole) | (place == 0), F.substring(col, 1, whole)).otherwise(cut)


def head_tail(col: Column, head: int = 2500, tail: int = 1000) -> Column:
    """The text, or its head and tail where it is longer than both."""
    return F.when(F.length(col) <= head + tail, col).otherwise(F.concat(F.substring(col, 1, head), F.lit("\n...\n"), F.substring(col, F.length(col) - tail + 1, F.lit(tail))))


def citation(number: Column, title: Column, doc: Column, article: Column, chapter: Column, chunk: Column) -> Column:
    """`[document | place | chunk]`: number, else title (50 characters), else the document's id; the article without what follows its dot."""
    long = F.when(F.length(title) > 50, F.concat(F.substring(title, 1, 50), F.lit("..."))).otherwise(title)
    label = F.coalesce(F.nullif(F.trim(number), F.lit("")), F.nullif(long, F.lit("")), F.concat(F.lit("Doc_"), doc))
    place = F.coalesce(F.nullif(F.trim(F.substring_index(article, ".", 1)), F.lit("")), F.nullif(F.trim(chapter), F.lit("")), F.lit("Toàn văn"))
    return F.concat(F.lit("["), label, F.lit(" | "), place, F.lit(" | "), chunk, F.lit("]"))


def sigmoid(col: Column) -> Column:
    """Logistic function, argument held within 700, four digits."""
    x = F.greatest(F.least(col, F.lit(700.0)), F.lit(-700.0))
    return F.round(1 / (1 + F.exp(-x)), 4)


def html_text(col: Column) -> Column:
    """Plain text of HTML: scripts and styles gone, a line end for each tag, entities for blanks resolved, empty lines dropped."""
    text = F.regexp_replace(col, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", "\n"), "&nbsp;|\\u00a0", " ")
    lines = F.transform(F.split(F.regexp_replace(text, r"[ \t]+", " "), "\n", -1), lambda x: F.trim(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def parse_roles(col: Column) -> Column:
    """Roles of a JSON list, else of a comma list without brackets and quotes; nothing gives Guest."""
    listed = F.from_json(col, "array<string>")
    parts = F.filter(F.transform(F.split(F.regexp_replace(col, r"[\[\]\"']", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    roles = F.coalesce(listed, parts)
    return F.when(F.coalesce(F.size(roles), F.lit(0)) <= 0, F.array(F.lit("Guest"))).otherwise(roles)


def normalised(vector: Column) -> Column:
    """Vector of length 1; null for a vector of zeros."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(size > 1e-9, F.transform(vector, lambda x: x.cast("double") / size))


#: Control and formatting characters that are dropped, line ends and tabs aside.
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{ad}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}]"
#: Headings at the start of a line, marks of lists and quotes before them aside, and references that are none.
CHAPTER_LINE = r"(?iu)^[\s#*`\"„“”—–-]*chương\s+([ivxlcdm0-9]+)"
ARTICLE_LINE = r"(?iu)^[\s#*`\"„“”—–-]*điều\s+([0-9]+[a-z]?)"
INLINE = r"(?iu)(?:quy định tại|căn cứ tại|theo|khoản\s+[0-9]+\s+của|điểm\s+[a-z]\s+khoản\s+[0-9]+\s+)\s+điều\s+[0-9]+"
#: What a legal text refers to, by kind.
LEGAL_PARTS = {
    "articles": r"(?iu)điều\s+([0-9]+)",
    "clauses": r"(?iu)khoản\s+([0-9]+)",
    "points": r"(?iu)điểm\s+([a-zđ])",
    "circulars": r"(?iu)thông tư\s+(?:số\s+)?([0-9]+(?:/[0-9]+/[-a-zA-Z0-9_đĐ]*)?)",
    "years": r"\b(20[0-9]{2}|19[0-9]{2})\b",
}


def nfc(col: Column) -> Column:
    """Composed form (NFC); Spark has no function for it, so whole batches go to pandas."""

    @F.pandas_udf("string")
    def composed(text: pd.Series) -> pd.Series:
        return text.str.normalize("NFC")

    return composed(col)


def normal_text(col: Column) -> Column:
    """Composed letters, line ends of one form, no control or formatting characters."""
    return F.regexp_replace(F.regexp_replace(nfc(col), "\r\n?", "\n"), CONTROL, "")


def first_heading(text: Column, pattern: str, name: str) -> Column:
    """`name n` of the first line that is such a heading and no reference in a sentence; null where there is none."""
    line = F.get(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(pattern) & ~x.rlike(INLINE)), F.lit(0))
    return F.concat(F.lit(name + " "), F.regexp_extract(line, pattern, 1))


def legal_parts(text: Column, kind: str) -> Column:
    """Sorted distinct references of one kind of LEGAL_PARTS, in small letters."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LEGAL_PARTS[kind]), 1), lambda x: F.lower(x))))


def pieces_within(text: str, size: int) -> list[str]:
    """Pieces of at most `size` characters, cut at the last blank that fits, else hard."""
    out, rest = [], text.strip(" ")
    while len(rest) > size:
        at = rest.rfind(" ", 0, size + 1)
        at = at if at > 0 else size
        out.append(rest[:at].strip(" "))
        rest = rest[at:].strip(" ")
    return [*out, rest] if rest else out


def within_limit(col: Column, size: int) -> Column:
    """array<string>: `pieces_within`; texts that fit are not handed to Python by their own length check."""

    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: pieces_within(t or "", size))

    short = F.trim(col)
    return F.when(F.length(short) <= size, F.filter(F.array(short), lambda x: x != "")).otherwise(cut(col))


def source_citation(source: Column, first: Column, last: Column, chunk: Column) -> Column:
    """`[Nguồn: source, tr. a-b, chunk: id]`; one page is written once."""
    pages = F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))
    return F.concat(F.lit("[Nguồn: "), source, F.lit(", tr. "), pages, F.lit(", chunk: "), chunk, F.lit("]"))


def file_name(col: Column) -> Column:
    """Characters that file systems forbid, and blanks, to underscores; no underscores in a row or at the ends."""
    return F.regexp_replace(F.regexp_replace(col, r'[\\/:*?"<>|\s]+', "_"), r"^_+|_+$", "")


def highlighted(col: Column, needle: str, before: str = "**", after: str = "**") -> Column:
    """Every occurrence of `needle`, whatever its case, between marks."""
    return F.regexp_replace(col, f"(?iu)({re.escape(needle)})", before + "$1" + after) if needle else col


def unfenced(col: Column) -> Column:
    """The text within a Markdown code fence, if there is one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def wiki_links(col: Column) -> Column:
    """Targets of [[target|alias]] and [[target#heading]], in written order."""
    found = F.regexp_extract_all(col, F.lit(r"\[\[([^\]\[]+)\]\]"), 1)
    return F.transform(found, lambda x: F.trim(F.substring_index(F.substring_index(x, "|", 1), "#", 1)))


def front_matter(col: Column) -> Column:
    """map<string,string> of the `key: value` lines between the first two lines of dashes; null where there are none."""
    head = F.regexp_extract(col, r"(?s)^---\n(.*?)\n---", 1)
    return F.when(head != "", F.map_from_entries(F.filter(F.transform(F.split(head, "\n"), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:?", "")))), lambda e: e["col1"] != "")))
