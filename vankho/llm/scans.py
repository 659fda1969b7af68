"""Noise in text from scanned pages (problem 4): furniture lines, cut words, misread characters; and the repaired text.

Misread words come from skip-gram vectors and glyph edits. A word's vector holds its mutual information with every word that stands
within WINDOW places of it anywhere in the corpus: the matrix that skip-gram training with negative sampling factorises, here in its
exact, sparse form (word, near, weight), so that no vocabulary lies on the driver. Each word is linked to the frequent words that it
could be a misreading of (same skeleton under the stated glyph confusions, any letter for a replacement character). A link holds only
if the frequent word's vector fits the places where the word stands; among several the line's own words decide, at each occurrence.
Furniture is what a source repeats at the edges of its pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vankho.functions.marks import fold
from vankho.llm.canonical import canonical_array
from vankho.llm.codepoints import slices
from vankho.operators.ordered import earliest, following, forward_fill
from vankho.runtime import broadcast_within, cut

#: A misreading in plain letters must be this many times rarer than the word it stands for; a known word has this many uses.
RARER, KNOWN = 10, 5
#: Places to each side that count as near, and the weight of a pair never seen.
WINDOW, UNSEEN = 2, -3.0
#: What spelling alone tells for a link, as the weight of PRIOR_PAIRS pairs: signs among letters speak for it, plain letters against it.
SIGNED, UNSIGNED, PRIOR_PAIRS = 3.0, -1.0, 4
#: Share of a source's pages that carry a line at the top or bottom for it to be furniture there, and the least number of pages.
TOP_SHARE, BOTTOM_SHARE, PAGES = 0.2, 0.4, 2
#: Pairs that a task adds up before it hands them on, and characters of the longest word.
HELD, LONGEST = 2_000_000, 40
#: Signs that an accent or stroke was read as a character of its own.
LOOSE_MARKS = r"?´'^*`~’"
#: What is read for a letter (left) and the letter (right); later pairs apply to what earlier ones leave.
SIGNS = [("†", "t"), ("0", "o"), ("6", "o"), ("9", "g"), ("!", "i"), ("5", "s"), ("8", "b"), ("|", "l")]
PAIRS = [("rn", "m"), ("ri", "n"), ("cl", "d"), ("ii", "u"), ("vv", "w")]
#: Forms of a line that only tells the page; the number is the first group.
PAGE_FORMS = [
    r"[-–~\[(]?\s*(\d+)\s*[-–~\])]?",
    r"(?:trang|tr\.?|p\.|page|pg\.)\s*(\d+)(?:\s*(?:/|of)\s*\d+)?",
    r"(\d+)\s*(?:\||/|of)\s*\d+",
]
#: Characters of the longest such line.
LONGEST_PAGE_LINE = 30
#: What parts words: blanks, strokes, quotes; hyphens between letters are parted too.
_PARTS = '[ \t\f\r\v/|–…“”"\x1f]+'
_OPEN, _FIXED_MANY = "\ue010", 200_000


def page_lines(pages: DataFrame) -> DataFrame:
    """(row_id, source, page, lines, numbers, edge) of each page with text, in the consistent form of characters.

    numbers: places of lines that only tell the page; edge: the first and the last two lines that are neither blank nor such. A page
    without source is a source of its own. Null and empty texts have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3):
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], canonical_array(batch.column(3))], names=["row_id", "source", "page", "text"])

    own = F.coalesce("source", F.concat(F.lit("\x00"), F.col("row_id").cast("string")))
    given = pages.where("text is not null and text <> ''").select("row_id", own.alias("source"), F.col("page_number").alias("page"), "text")
    texts = given.mapInArrow(run, "row_id bigint, source string, page int, text string").withColumn("lines", F.split("text", "\n", -1)).drop("text")
    placed = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), _tells_page(x, F.col("page")).alias("tells")))
    marked = texts.withColumn("solid", F.filter(placed, lambda e: F.trim(e["line"]) != ""))
    numbers = F.transform(F.filter("solid", lambda e: e["tells"]), lambda e: e["line_no"])
    marked = marked.select("row_id", "source", "page", "lines", numbers.alias("numbers"), F.filter("solid", lambda e: ~e["tells"]).alias("rest"))
    n = F.size("rest")
    edge = F.transform("rest", lambda e, i: F.struct(e["line_no"].alias("line_no"), e["line"].alias("line"), (i == 0).alias("first"), (i >= n - 2).alias("last")))
    return marked.select("row_id", "source", "page", "lines", "numbers", F.filter(edge, lambda e: e["first"] | e["last"]).alias("edge"))


def _tells_page(line: Column, page: Column) -> Column:
    """The line has a form of a page number, and the number is the page's."""
    text = F.lower(F.trim(line))
    digits = F.regexp_replace(F.regexp_replace(text, r"(?<![\p{L}])[ol]{1,3}(?![\p{L}])|(?<=\d)[ol]|[ol](?=\d)", "0"), r"[^\x00-\x7f–]", "")
    number = F.coalesce(*[F.nullif(F.regexp_extract(digits, f"^{form}$", 1), F.lit("")) for form in PAGE_FORMS])
    # the forms are short: longer lines are not looked at
    return F.when(F.length(text) <= LONGEST_PAGE_LINE, F.coalesce(number.try_cast("int") == page, F.lit(False))).otherwise(F.lit(False))


def furniture(pages: DataFrame) -> DataFrame:
    """(row_id, line_no, noise) of running lines and page numbers of `page_lines`.

    A line at a page's edge is furniture if its source repeats it (digits, case and accents aside) there on enough pages, or is within
    a few edits of such a line, or if it is established furniture of two other sources. A top line of the first page in capitals and
    without a number is the title. Misread characters are undone before lines are compared.
    """
    numbers = pages.select("row_id", F.explode("numbers").alias("line_no"))
    edge = pages.select("row_id", "source", "page", F.inline("edge"))
    text = fold(F.regexp_replace("line", r"\s{2,}\d+\s*$", ""))
    text = F.regexp_replace(text, rf"(?<=[a-z])[{LOOSE_MARKS}]+|�", "")
    key = F.trim(F.regexp_replace(_undone(F.regexp_replace(text, r"(?<![a-z†!])\d+(?![a-z†!])", "#"), "h"), r"\s+", " "))
    title = (F.col("page") <= 1) & (F.upper("line") == F.col("line")) & ~F.col("key").contains("#")
    edge = edge.withColumn("key", key).withColumn("place", F.when(F.col("first") & ~title, "top").when(F.col("last"), "bottom"))
    edge = cut(edge.where("place is not null and length(key) >= 6").select("row_id", "source", "page", "line_no", "key", "place"))
    counted = edge.groupBy("source", "place", "key").agg(F.count_distinct("page").alias("pages"))
    size = pages.groupBy("source").agg(F.count_distinct("page").alias("size"))
    share = F.when(F.col("place") == "top", TOP_SHARE).otherwise(BOTTOM_SHARE)
    running = counted.join(size, "source").where((F.col("pages") >= PAGES) & (F.col("pages") >= share * F.col("size"))).select("source", "place", "key", "pages")
    running = cut(running)
    # established: furniture of two sources by pages of their own, three at least in each
    wide = running.where("pages >= 3").groupBy("place", "key").agg(F.count_distinct("source").alias("sources")).where("sources >= 2").select("place", "key")
    by_key = edge.join(running.select("source", "place", "key"), ["source", "place", "key"], "left_semi").select("row_id", "line_no")
    by_wide = edge.join(wide, ["place", "key"], "left_semi").select("row_id", "line_no")
    rest = edge.join(running.select("source", "place", "key"), ["source", "place", "key"], "left_anti")
    # few keys of a source can reach the share of its pages: a page has one top line and two bottom lines
    known = running.groupBy("source", "place").agg(F.collect_set("key").alias("keys"))
    close = rest.join(known, ["source", "place"]).where(F.exists("keys", lambda k: F.levenshtein(k, F.col("key")) <= F.length(k) * 0.15)).select("row_id", "line_no")
    lines_found = by_key.unionAll(by_wide).unionAll(close).distinct().withColumn("noise", F.lit("running_line"))
    return lines_found.unionAll(numbers.select("row_id", "line_no", F.lit("page_number").alias("noise")))


def _undone(text: Column, one: str) -> Column:
    """Every stated confusion undone; `one` says what a 1 (and, with i, a 6) was."""
    for sign, letter in [*([("l1", "h")] if one == "h" else []), ("1", "i" if one == "i" else "l"), *([("6", "b")] if one == "i" else []), *SIGNS, *PAIRS]:
        text = F.replace(text, F.lit(sign), F.lit(letter))
    return text


def _skeletons(word: Column) -> Column:
    """array<string>: what the word comes to when every stated confusion is undone."""
    bare = fold(F.regexp_replace(word, rf"(?<=[\p{{L}}])[{LOOSE_MARKS}]+", ""))
    return F.array_distinct(F.array(*[_undone(bare, one) for one in "hli"]))


def word_lists(lines: pa.Array) -> pa.ListArray:
    """Lower-case words of each line, outer punctuation off; parts around slashes and hyphens on their own; may hold ""."""
    low = pc.utf8_lower(lines)
    for _ in range(2):
        low = pc.replace_substring_regex(low, r"(\p{L})-(\p{L})", "\\1\x1f\\2")
    pieces = pc.split_pattern_regex(low, _PARTS)
    kinds = pieces.values.dictionary_encode()
    bare = pc.replace_substring_regex(pc.replace_substring_regex(kinds.dictionary, r"^[^\p{L}\p{N}†�!]+", ""), r"[.,;:)\]>=+]+$", "")
    return pa.ListArray.from_arrays(pieces.offsets, bare.take(kinds.indices))


_SEPARATOR = regex.compile(r'[ \t\f\r\v/|–…“”"]+|(?<=\p{L})-(?=\p{L})')
_CORE = regex.compile(r"^[^\p{L}\p{N}†�!]*(.*?)[.,;:)\]>=+]*$", regex.S)


def with_words(line: str, fixes: dict[int, str]) -> str:
    """The line with its words at the given places (those of `word_lists`) replaced, capitals carried over."""
    parts, end = [], 0
    ends = [m.span() for m in _SEPARATOR.finditer(line)] + [(len(line), len(line))]
    for at, (a, b) in enumerate(ends):
        piece = line[end:a]
        if at in fixes:
            m = _CORE.match(piece)
            word, new = m.group(1), fixes[at]
            letters = [c for c in word if c.isalpha()]
            if len(letters) > 1 and all(c.isupper() for c in letters):
                new = new.upper()
            elif letters and letters[0].isupper():
                new = new[:1].upper() + new[1:]
            piece = piece[: m.start(1)] + new + piece[m.end(1) :]
        parts += [piece, line[a:b]]
        end = b
    return "".join(parts)


def body_lines(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(row_id, line_no, line, rest, words) of lines that are neither blank nor furniture; rest: the first word of the next such line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, word_lists(batch.column(2))], names=["row_id", "line_no", "line", "rest", "words"])

    taken = edges.groupBy("row_id").agg(F.collect_set("line_no").alias("taken"))
    kept = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    none = F.coalesce("taken", F.array().cast("array<int>"))
    body = pages.select("row_id", "lines").join(taken.hint("merge"), "row_id", "left").select("row_id", F.filter(kept, lambda e: (F.trim(e["line"]) != "") & ~F.array_contains(none, e["line_no"])).alias("b"))
    rest = lambda i: F.regexp_extract(F.coalesce(F.get("b", i + 1)["line"], F.lit("")), r"^\s*([^\s,.;:)/]+)", 1)
    rows = body.select("row_id", F.inline(F.transform("b", lambda e, i: F.struct(e["line_no"].alias("line_no"), e["line"].alias("line"), rest(i).alias("rest")))))
    return rows.mapInArrow(run, "row_id bigint, line_no int, line string, rest string, words array<string>")


def skip_grams(body: DataFrame) -> DataFrame:
    """(word, near, n): how often `near` stands within WINDOW places of `word` in a line; near is null for the uses of the word itself.

    Tokens without letters and overlong ones are one word, #. Each task adds up its pairs before they are shuffled.
    """

    def flush(names: dict[str, int], keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        all_names = pa.array([*names, None], pa.string())
        word, near = keys >> 32, (keys & 0xFFFFFFFF) - 1
        near = np.where(near < 0, len(names), near)
        return pa.RecordBatch.from_arrays([all_names.take(pa.array(word)), all_names.take(pa.array(near)), pa.array(counts)], names=["word", "near", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            lists = batch.column(0)
            line = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            kinds = lists.flatten().dictionary_encode()
            kept = pc.not_equal(kinds.dictionary, "").to_numpy(zero_copy_only=False)
            worded = pc.and_(pc.match_substring_regex(kinds.dictionary, r"\p{L}|�|†"), pc.less_equal(pc.utf8_length(kinds.dictionary), LONGEST))
            own = pc.if_else(worded, kinds.dictionary, "#").to_pylist()
            number = np.array([names.setdefault(w, len(names)) for w in own] or [0], np.int64)
            index = kinds.indices.to_numpy(zero_copy_only=False)
            solid = kept[index] if len(index) else np.zeros(0, bool)
            line, at = line[solid], number[index[solid]]
            found = [(at << 32)]
            for gap in range(1, WINDOW + 1):
                same = line[gap:] == line[:-gap]
                a, b = at[:-gap][same], at[gap:][same]
                found += [(a << 32) | (b + 1), (b << 32) | (a + 1)]
            fresh, n = np.unique(np.concatenate(found), return_counts=True)
            both, place = np.unique(np.concatenate([keys, fresh]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, n]), len(both)).astype(np.int64)
            keys = both
            if len(keys) > HELD:
                yield flush(names, keys, counts)
                names, keys, counts = {}, keys[:0], counts[:0]
        if len(keys):
            yield flush(names, keys, counts)

    return body.select("words").mapInArrow(run, "word string, near string, n bigint").groupBy("word", "near").agg(F.sum("n").alias("n"))


def word_sums(grams: DataFrame) -> DataFrame:
    """(word, s): how many pairs each word stands in."""
    return grams.where("near is not null").groupBy("word").agg(F.sum("n").alias("s"))


def with_weights(df: DataFrame, grams: DataFrame, sums: DataFrame) -> DataFrame:
    """`df`(correction, near, ...) with `weight`: the entry of the correction's vector at `near`.

    Log of how much more often the two stand near one another than by chance; a pair never seen counts as half a pair, is never above
    0 and never below UNSEEN, so that it tells little where few pairs were to be expected. A missing `near` weighs nothing.
    """
    total = sums.agg(F.sum("s").alias("s")).first().s or 1
    mine, theirs = sums.select(F.col("word").alias("correction"), F.col("s").alias("_s")), sums.select(F.col("word").alias("near"), F.col("s").alias("_t"))
    seen = grams.where("near is not null").select(F.col("word").alias("correction"), "near", F.col("n").alias("_n"))
    joined = df.join(seen, ["correction", "near"], "left").join(mine, "correction", "left").join(theirs, "near", "left")
    log = F.log(F.coalesce(F.col("_n").cast("double"), F.lit(0.5)) * float(total) / (F.col("_s").cast("double") * F.col("_t")))
    weight = F.when(F.col("_n").isNotNull(), log).otherwise(F.greatest(F.least(log, F.lit(0.0)), F.lit(UNSEEN)))
    return joined.withColumn("weight", F.coalesce(weight, F.lit(0.0))).drop("_n", "_s", "_t")


def links(grams: DataFrame, sums: DataFrame) -> DataFrame:
    """(word, correction, score) of words and the frequent words that they may be misreadings of, by skeleton and by vectors.

    A word with signs or digits among its letters needs a known word of its skeleton that is no rarer; a word in plain letters must
    also be RARER times less frequent and differ in more than accents; one with a replacement character needs a known word with some
    letter there. The link holds if the correction's vector over all words near the misreading's places, together with what the
    spelling tells, speaks for it.
    """
    counts = grams.where("near is null and word <> '#'").select("word", "n")
    plain = F.col("word").rlike(r"^\p{L}+$")
    known = counts.where(plain & (F.col("n") >= KNOWN)).select(F.col("word").alias("correction"), F.col("n").alias("uses"), fold(F.col("word")).alias("_fold"))
    indexed = known.withColumn("skeleton", F.explode(_skeletons(F.col("correction"))))
    letters = F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"^\d+[a-z]{1,2}$")
    asked = counts.where(letters).withColumn("skeleton", F.explode(_skeletons(F.col("word")))).withColumn("plain", plain)
    linked = asked.join(indexed, "skeleton").where((F.col("word") != F.col("correction")))
    rare = F.col("n") * RARER <= F.col("uses")
    linked = linked.where((~F.col("plain") & (F.col("n") <= F.col("uses"))) | (F.col("plain") & rare & (fold(F.col("word")) != F.col("_fold"))))
    # a known word with a stop after it is itself
    stem = F.regexp_replace("word", r"[!?'’*]+$", "")
    linked = linked.withColumn("stem", stem).join(known.select(F.col("correction").alias("stem"), F.lit(True).alias("whole")), "stem", "left").where("whole is null or plain")
    masks = F.transform(F.sequence(F.lit(1), F.length("correction")), lambda i: F.overlay(F.col("correction"), F.lit("�"), i, F.lit(1)))
    lost = counts.where(F.col("word").contains("�")).join(known.withColumn("word", F.explode(masks)), "word").where("n <= uses")
    pairs = linked.select("word", "correction", "uses").unionAll(lost.select("word", "correction", "uses")).distinct()
    around = pairs.join(grams.where("near is not null"), "word", "left")
    prior = F.when(plain, UNSIGNED).otherwise(SIGNED)
    # where a word stands for several words, each place speaks for or against the one that fits it best
    here = Window.partitionBy("word", "near")
    told = with_weights(around, grams, sums).withColumn("n", F.coalesce("n", F.lit(0))).withColumn("own", F.when(F.col("weight") >= F.max("weight").over(here), F.col("n")).otherwise(0))
    fit = (F.sum(F.col("own") * F.col("weight")) + prior * PRIOR_PAIRS) / (F.sum("own") + PRIOR_PAIRS)
    whole = F.coalesce(F.try_divide(F.sum(F.col("n") * F.col("weight")), F.sum("n")), F.lit(0.0)) + F.log10("uses") / 2
    fitted = told.groupBy("word", "correction", "uses").agg(fit.alias("fit"), whole.alias("score"), F.sum("own").alias("own"), F.sum("n").alias("n"))
    return fitted.where("fit >= 0 and (own > 0 or n = 0)").select("word", "correction", "score")


def misreadings(body: DataFrame, grams: DataFrame) -> DataFrame:
    """(row_id, line_no, at, word, correction) of every misread word: each occurrence of a linked word, with the correction that the words
    near it fit best. A replacement character, or a dagger beside letters, always tells a misreading; its correction is null if none fits.
    """
    sums = cut(word_sums(grams))
    linked = cut(links(grams, sums))
    told = F.col("word").contains("�") | F.col("word").rlike(r"\p{L}†|†\p{L}")
    sure = grams.where(F.col("near").isNull() & told).join(linked, "word", "left_anti").select("word", F.lit(None).cast("string").alias("correction"), F.lit(0.0).alias("score"))
    options = linked.unionAll(sure).groupBy("word").agg(F.collect_list(F.struct("correction", "score")).alias("options"))
    words = body.select("row_id", "line_no", "words", F.posexplode("words").alias("at", "word")).where("word <> ''")
    found = words.join(broadcast_within(options, _FIXED_MANY), "word")
    near = F.filter(F.slice(F.col("words"), F.greatest(F.col("at") - WINDOW + 1, F.lit(1)), F.lit(2 * WINDOW + 1)), lambda w: w != F.col("word"))
    found = cut(found.select("row_id", "line_no", "at", "word", "options", F.when(F.size("options") > 1, near).alias("near")))
    one = found.where("size(options) = 1").select("row_id", "line_no", "at", "word", F.get("options", F.lit(0))["correction"].alias("correction"))
    many = found.where("size(options) > 1").select("row_id", "line_no", "at", "word", F.explode("options").alias("o"), "near").select("row_id", "line_no", "at", "word", "o.*", "near")
    each = many.select("row_id", "line_no", "at", "word", "correction", "score", F.explode_outer("near").alias("near"))
    fitted = with_weights(each, grams, sums).groupBy("row_id", "line_no", "at", "word", "correction", "score").agg(F.avg("weight").alias("here"))
    best = fitted.groupBy("row_id", "line_no", "at", "word").agg(F.max(F.struct(F.col("score") + F.col("here"), "correction")).alias("best"))
    return one.unionAll(best.select("row_id", "line_no", "at", "word", "best.correction"))


def cut_words(body: DataFrame, known: DataFrame) -> DataFrame:
    """(row_id, line_no, last) of body lines that end with the first half of a word; last: place of the half among the line's words.

    The mark is a not-sign, or a hyphen after letters where the halves make a known word, or where the first half is none itself.
    """
    ended = body.where(F.col("line").rlike(r"\p{L}[!†�?´'^*0-9]*[-¬‐]\s*$"))
    half, rest = F.regexp_extract("line", r"([^\s/(“\"]+)[-¬‐]\s*$", 1), F.col("rest")
    ended = ended.select(
        "row_id", "line_no", (F.size("words") - 1).alias("last"), F.col("line").rlike(r"¬\s*$").alias("sure"), F.lower(half).alias("half"), half.rlike(r"^\p{L}?\p{Ll}[^\p{Lu}]*$|^\p{Lu}$|^\p{Lu}+$").alias("worded"),
        F.lower(rest).alias("rest"), (rest == "").alias("open"), rest.rlike(r"^[\p{L}!†�]").alias("goes"),
    )
    joined = ended.withColumn("joined", F.concat("half", "rest"))
    whole = known.select(F.col("word").alias("joined"), F.lit(True).alias("is_word"))
    half_known = known.select(F.col("word").alias("half"), F.lit(True).alias("is_half"))
    told = joined.join(whole, "joined", "left").join(half_known, "half", "left")
    keep = F.col("sure") | (F.col("worded") & (F.col("is_word").isNotNull() | (F.col("is_half").isNull() & (F.col("open") | F.col("goes")))))
    return told.where(keep).select("row_id", "line_no", "last")


def analyse(pages: DataFrame) -> dict[str, DataFrame]:
    """pages, furniture, body lines, cut words and misread words of all pages.

    Halves of a cut word are not words: the last of the line and the first of the next are no misreadings, unless they hold signs.
    """
    own = cut(page_lines(pages))
    edges = cut(furniture(own))
    body = cut(body_lines(own, edges))
    grams = cut(skip_grams(body))
    known = grams.where(F.col("near").isNull() & F.col("word").rlike(r"^\p{L}+$") & (F.col("n") >= KNOWN)).select("word")
    halves = cut(cut_words(body, known))
    sides = halves.select("row_id", "line_no", F.col("last").alias("at")).unionAll(halves.select("row_id", (F.col("line_no") + 1).alias("line_no"), F.lit(0).alias("at")))
    found = cut(misreadings(body, grams))
    plain = F.col("word").rlike(r"^[\p{L}\-¬]+$")
    misread = found.where(~plain).unionAll(found.where(plain).join(sides, ["row_id", "line_no", "at"], "left_anti").select(*found.columns))
    return {"pages": own, "furniture": edges, "body": body, "halves": halves, "misread": misread}


def noise_lines(pages: DataFrame) -> DataFrame:
    """(row_id, line_no, noise): one row for each line of a page and kind of noise on it; null and empty texts have none."""
    a = analyse(pages)
    split, misread = a["halves"].select("row_id", "line_no", F.lit("split_word").alias("noise")), a["misread"].select("row_id", "line_no", F.lit("misread").alias("noise")).distinct()
    return a["furniture"].select("row_id", "line_no", "noise").unionAll(split).unionAll(misread)


def _paragraphs(a: dict[str, DataFrame]) -> DataFrame:
    """(row_id, source, page, paragraphs) of each page: furniture gone, cut words joined, misreadings replaced, lines joined.

    A last paragraph that ends with the first half of a word keeps a mark at its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mended = [with_words(line, {f["at"]: f["correction"] for f in fixes}) for line, fixes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mended, pa.string())], names=["row_id", "line_no", "line"])

    fixes = a["misread"].where("correction is not null").groupBy("row_id", "line_no").agg(F.collect_list(F.struct("at", "correction")).alias("fixes"))
    mended = a["body"].select("row_id", "line_no", "line").join(fixes.hint("merge"), ["row_id", "line_no"]).select("row_id", "line_no", "line", "fixes").mapInArrow(run, "row_id bigint, line_no int, line string")
    # what belongs to a page is gathered first, so that pages are joined once, never line by line and never by broadcast
    by_page = lambda df, value, name: df.groupBy("row_id").agg(F.collect_list(value).alias(name)).hint("merge")
    parts = a["pages"].select("row_id", "source", "page", "lines")
    parts = parts.join(by_page(a["furniture"], "line_no", "taken"), "row_id", "left").join(by_page(a["halves"], "line_no", "cut"), "row_id", "left").join(by_page(mended, F.struct("line_no", "line"), "mended"), "row_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast("array<int>"))
    lines = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line_no"), F.coalesce(F.get(F.filter("mended", lambda m: m["line_no"] == i + 1), F.lit(0))["line"], x).alias("line")))
    kept = parts.select("row_id", "source", "page", none("cut").alias("cut"), F.filter(lines, lambda e: ~F.array_contains(none("taken"), e["line_no"])).alias("kept"))
    flat = F.transform("kept", lambda e: F.when(F.array_contains("cut", e["line_no"]), F.concat(F.regexp_replace(F.trim(e["line"]), r"[-¬‐]$", ""), F.lit(_OPEN))).otherwise(F.trim(e["line"])))
    whole = F.regexp_replace(F.array_join(flat, "\n"), f"{_OPEN}\n+(?!$)", "")
    split = F.filter(F.transform(F.split(whole, "\n{2,}"), lambda p: F.trim(F.regexp_replace(p, "\n", " "))), lambda p: p != "")
    return kept.select("row_id", "source", "page", split.alias("paragraphs"))


def repaired(pages: DataFrame) -> DataFrame:
    """(row_id, text) of each page with text: its paragraphs parted by blank lines; "" where furniture is all there is."""
    text = F.replace(F.array_join("paragraphs", "\n\n"), F.lit(_OPEN), F.lit(""))
    return _paragraphs(analyse(pages)).select("row_id", text.alias("text"))


def continuous(pages: DataFrame) -> DataFrame:
    """(row_id, paragraph, text): continuous paragraphs; row_id and number are those of the page on which the paragraph begins.

    A paragraph goes on over the page's end if it stops without a full stop and the source's next page goes on in small letters, or if
    its last word is cut. A page sent again, one without source or without number is on its own; a page without body text has no row.
    """
    page = cut(_paragraphs(analyse(pages)).where(F.size("paragraphs") > 0))
    first = earliest(page.where("page is not null").select("source", "page", "row_id"), ["source", "page"], ["row_id"]).select("row_id", F.lit(True).alias("first"))
    alone = F.concat(F.lit("\x00"), F.col("row_id").cast("string"))
    page = page.join(first.hint("merge"), "row_id", "left").select("row_id", F.when(F.col("first"), F.col("source")).otherwise(alone).alias("book"), F.coalesce("page", F.lit(0)).alias("page"), "paragraphs")
    last, begin = F.element_at("paragraphs", -1), F.get("paragraphs", F.lit(0))
    ends = page.select("row_id", "book", "page", last.endswith(_OPEN).alias("half"), (~last.rlike(r"[.!?:;][\"'”’)\]]*$")).alias("open"), F.struct("row_id", "page", begin.rlike(r"^\p{Ll}").alias("low")).alias("own"))
    nexts = following(ends, ["book"], "page", "own", "next").where((F.col("next.page") == F.col("page") + 1) & (F.col("half") | (F.col("open") & F.col("next.low"))))
    goes_on = nexts.select(F.col("next.row_id").alias("row_id"), F.lit(True).alias("goes_on"))
    pieces = page.join(goes_on.hint("merge"), "row_id", "left").select("row_id", "book", "page", "goes_on", F.posexplode("paragraphs").alias("number", "text"))
    place = F.col("page").cast("bigint") * (1 << 20) + F.col("number")
    pieces = pieces.withColumn("place", place).withColumn("start", F.when(~(F.coalesce("goes_on", F.lit(False)) & (F.col("number") == 0)), F.struct("place", "row_id", "number")))
    placed = forward_fill(pieces, ["book"], "place", "start", "begins", block=64 << 20)
    joined = placed.groupBy("book", "begins").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("all"))
    text = F.regexp_replace(F.regexp_replace(F.array_join(F.transform("all", lambda p: p["text"]), "\n"), f"{_OPEN}\n?", ""), "\n", " ")
    return joined.select(F.col("begins.row_id").alias("row_id"), (F.col("begins.number") + 1).alias("paragraph"), text.alias("text"))
