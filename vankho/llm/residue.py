"""Template residue and error-page text (problem 8): near-duplicate segments by SimHash tables, labels spread from trusted ones.

A text's lines are its segments; lines that differ only in digits and codes are one class. Trusted are lines with unfilled placeholders,
protocol and program residue, filler that repeats itself or is made of placeholder Latin, and messages that are all that a document
holds. From these the labels spread: to every line of the same class, wherever it stands, and from class to class along near-duplicates
until no new class is reached, which labels the connected components of trusted classes. Near-duplicates meet in partitioned SimHash
tables, then their Hamming distance and their five-word shingles (SIMILARITY) are compared.
What makes a line residue is its core: the shingles that touch the matched words. A line that is alike but for the core (a placeholder
filled in, a text without the notice before it) is no residue, so a label passes only to lines that share a shingle of the core.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vankho.llm import codepoints as C
from vankho.llm.words import words
from vankho.runtime import cut

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of a filter for each shingle and each key of a table, and of the whole filter at most (its exponent).
FILTER_BITS, TABLE_BITS, LARGEST_FILTER = 64, 16, 27
#: Words that a task adds up before it hands them on.
HELD_WORDS = 1_000_000

#: SimHash blocks and bits of a block; every two blocks are a table. Most bits in which near-duplicates differ: of pairs at SIMILARITY
#: 95 in 100 at least are found (tested); up to BLOCKS - 2 bits none is lost in the tables.
BLOCKS, BLOCK_BITS, HAMMING = 12, 5, 16
#: Share of a document's characters in messages and residue from which messages are trusted, and most words of a message's line.
ALONE, MESSAGE_WORDS = 0.6, 30
#: Words from which repetition counts, different words in so many of them, and the share of words of placeholder Latin.
LEAST_WORDS, FEW_KINDS, LATIN_SHARE = 8, 3, 0.8
#: A word is placeholder Latin if this share of its uses, at least so many, stands in lines with a word of the standard passage.
BESIDE, USES = 0.5, 3

#: Names of form fields in written-out placeholders.
_FIELD = r"(?:Tên|Họ tên|Số tiền|Số hợp đồng|Số|Điền|Chèn|Nhập|Ghi|Địa chỉ|Chức vụ|ngày/tháng|(?i:your|insert|enter|customer|client|company|full name|name|address|amount|date)\b)"
#: Patterns of unfilled placeholders. One that stands alone between quotation marks is talked about, not left over.
PLACEHOLDERS = [
    r"\{\{ *\w+[^{}\n]*\}\}",
    r"\$\{\w+\}",
    r"<<\w+>>",
    r"@@\w+@@",
    r"\b__[A-Z][A-Z0-9_]*__",
    r"\[\[\w+\]\]",
    r"%\(\w+\)[sd]",
    r"<%=? *\w+ *%>",
    r"#\{\w+\}",
    r"(?:^|[^{$#\w])\{(?:[a-z]+(?:_[a-z0-9]+)+|name|date|amount|address|title|number)\}",
    rf"\[{_FIELD}[^\[\]\n]{{0,40}}\]",
    rf"<{_FIELD}[^<>\n]{{0,40}}>",
    rf"«{_FIELD}[^«»\n]{{0,40}}»",
]
#: What protocols, programs and editors leave behind; trusted wherever it stands.
LEFTOVERS = [
    r"^\s*[45][0-9]{2}\s+\p{Lu}\p{L}+(?: \p{L}+){0,5}\s*(?:[.:]|$)",
    r"^\s*HTTP/[0-9.]+ [345][0-9]{2}\b",
    r"<h1>\s*[45][0-9]{2}\s*</h1>",
    r"^\s*Traceback \(most recent call last\)",
    r"^\s*File \"[^\"]+\", line [0-9]+, in ",
    r"\b(?:TODO|FIXME|TBD)\s*[–:-]",
    r"(?i:\blorem ipsum\b)",
    r"(?i:(?:\b(?:" + "|".join(f"{c}{{2,}}" for c in "abcdefghijklmnopqrstuvwxyz") + r")\b[ .,]*){4,})",
]
#: Common turns of error messages, notices about scripts and standing-in texts, in both languages. They also occur in
#: texts that talk about such things, so they are trusted only where they are all that a document holds.
MESSAGES = [
    r"(?:có|xảy ra|gặp) lỗi",
    r"không (?:tìm thấy|tồn tại|phục vụ được|truy cập được|khả dụng)",
    r"không có quyền (?:mở|xem|truy cập)",
    r"(?:phiên .*hết hạn|session (?:has )?expired)",
    r"(?:đang bảo trì|under maintenance|too many requests|try again later)",
    r"(?:kết nối .*(?:thất bại|bị từ chối)|connection (?:failed|refused|timed out)|an error (?:has )?occurred)",
    r"\b(?:javascript|scripts?)\b|tập lệnh|kịch bản",
    r"(?:đang được cập nhật|chưa có nội dung|đang chờ biên tập|sẽ được bổ sung|coming soon|under construction)",
    r"(?:(?:văn bản|tiêu đề|nội dung) mẫu|văn bản thử|chữ (?:giữ chỗ|thử|mẫu)|sample text|placeholder text)",
]
#: Words of the standard passage of placeholder Latin that no other language of the corpus has.
LATIN = (
    "lorem ipsum dolor amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum"
).split()
_QUOTED = r"[\"'“”‘’`]"
_PLACEHOLDER = re.compile("|".join(f"(?:{p})" for p in PLACEHOLDERS))
_LEFTOVER = "|".join(f"(?:{p})" for p in LEFTOVERS)
_MESSAGE = "(?i:" + "|".join(f"(?:{p})" for p in MESSAGES) + ")"
_NOTICE_PLACES = regex.compile(f"{_LEFTOVER}|{_MESSAGE}")


def _left_over(line: str) -> Iterator[re.Match]:
    """Placeholders of a line that do not stand alone between quotation marks."""
    for m in _PLACEHOLDER.finditer(line):
        if not (re.search(_QUOTED + r"\s*$", line[: m.start()]) and re.match(r"\s*" + _QUOTED, line[m.end() :])):
            yield m


def left_over(line: str) -> bool:
    """True if a line has a placeholder that does not stand alone between quotation marks."""
    return next(_left_over(line), None) is not None


def beside_residue(line: str) -> list[str]:
    """Parts of a trusted line outside its placeholders and what notices match."""
    spans = [m.span() for found in (_left_over(line), _NOTICE_PLACES.finditer(line)) for m in found]
    parts, end = [], 0
    for a, b in sorted(spans):
        if a > end:
            parts.append(line[end:a])
        end = max(end, b)
    return [*parts, line[end:]]


def repeats_itself(line: str) -> bool:
    """True if at least half of a line's sentences are there twice."""
    sentences = [x.strip() for x in re.split(r"(?<=[.!?])\s+", line) if x.strip()]
    return len(sentences) > 1 and 2 * len(set(sentences)) <= len(sentences)


def trusted(lines: pa.Array, words_in: np.ndarray, kinds_in: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are residue by themselves, and which only quote a placeholder. Whole batches are matched by Arrow; single lines are
    looked at only where they hold signs of placeholders or few different words.

    words_in, kinds_in: how many words and how many different words a line has.
    """
    found, quoted = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    # a line with none of these letters matches no pattern
    marks = pc.match_substring_regex(lines, r"[{<«\[]|@@|__|%\(").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(marks)
    marked = lines.take(pa.array(at)).to_pylist()
    found[at] = [left_over(line) for line in marked]
    quoted[at] = [bool(_PLACEHOLDER.search(line)) for line in marked]
    quoted &= ~found
    found |= pc.match_substring_regex(lines, _LEFTOVER).to_numpy(zero_copy_only=False)
    found |= (words_in >= LEAST_WORDS) & (kinds_in <= FEW_KINDS)
    again = np.flatnonzero((words_in >= LEAST_WORDS) & (2 * kinds_in <= words_in) & ~found)
    found[again] = [repeats_itself(line) for line in lines.take(pa.array(again)).to_pylist()]
    quoted |= pc.match_substring_regex(lines, r"^\s*" + _QUOTED).to_numpy(zero_copy_only=False)
    return found, quoted


def _lines(text: pa.Array, doc: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Non-blank lines of a batch, and each one's document."""
    split = pc.split_pattern(text.cast(pa.large_string()), "\n")
    lines, parent = split.flatten(), split.value_parent_indices() if hasattr(split, "value_parent_indices") else pc.list_parent_indices(split)
    solid = pc.match_substring_regex(lines, r"\S")
    return lines.filter(solid), doc[parent.filter(solid).to_numpy(zero_copy_only=False)]


def shingles(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles of all segments and the segment of each; shorter segments are one shingle."""
    n = np.diff(starts)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    segment = np.repeat(np.arange(len(n)), count)
    first = np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
    out = np.zeros(len(first), np.uint64)
    end = starts[1:][segment]
    for j in range(SHINGLE):
        at = first + j
        word = hashes[np.minimum(at, len(hashes) - 1)] if len(hashes) else np.zeros(len(at), np.uint64)
        out = np.where(at < end, (out ^ word) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j + 1), out)
    out ^= out >> np.uint64(31)
    return out, segment


def simhash(shingle: np.ndarray, segment: np.ndarray, segments: int) -> np.ndarray:
    """64-bit SimHash of every segment; bits are counted in 16-bit lanes of 64-bit words, four bits at a time."""
    out = np.zeros(segments, np.uint64)
    if not len(shingle):
        return out
    # pieces of at most 32,768 shingles, so that no lane overflows
    fresh = np.ones(len(segment), bool)
    fresh[1:] = segment[1:] != segment[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(segment)), 0))
    piece = np.flatnonzero((np.arange(len(segment)) - begin) % 32768 == 0)
    owner = segment[piece]
    size = np.diff(np.append(piece, len(segment)))
    ones = np.empty(len(piece), np.uint64)
    lanes = np.uint64(0x0001000100010001)
    single = bool((np.diff(owner) != 0).all())
    total = np.bincount(owner, weights=size, minlength=segments).astype(np.int64)
    for shift in range(16):
        ones = np.add.reduceat((shingle >> np.uint64(shift)) & lanes, piece)
        for lane in range(4):
            counted = ((ones >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
            if single:
                more = np.zeros(segments, np.int64)
                more[owner] = counted
            else:
                more = np.bincount(owner, weights=counted, minlength=segments).astype(np.int64)
            out |= (2 * more > total).astype(np.uint64) << np.uint64(16 * lane + shift)
    return out


def _masked(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of every line; words with a digit count as one and the same word."""
    cp, starts = C.decode(lines)
    masked = cp.copy()
    digit = (cp >= 48) & (cp < 58)
    masked[digit] = 48
    # a run of digits and hex letters that holds a digit is a code: its characters all become one digit, and runs have one length
    hexed = digit | ((cp >= 97) & (cp < 103))
    fresh = hexed.copy()
    fresh[1:] &= ~hexed[:-1]
    fresh[starts[:-1][starts[:-1] < len(cp)]] |= hexed[starts[:-1][starts[:-1] < len(cp)]]
    run = np.cumsum(fresh)
    coded = np.bincount(run[digit], minlength=run[-1] + 1 if len(run) else 1) > 0
    code = hexed & coded[run] if len(run) else hexed
    masked[code] = 48
    drop = code & ~(fresh & code)
    masked, starts = C.keep(masked, starts, ~drop)
    hashes, _, word_starts = words(masked, starts)
    return hashes, word_starts


def _classes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of every line, its shingles and its words. Only lines that begin with a quotation mark share a class with such lines."""
    hashes, word_starts = _masked(lines)
    shingle, segment = shingles(hashes, word_starts)
    # the class is all shingles in order; lines without words (rules, dots) have the class of their length
    key = np.zeros(len(lines), np.uint64)
    if len(hashes):
        place = np.arange(len(hashes)) - np.repeat(word_starts[:-1], np.diff(word_starts))
        mixed = (hashes + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed)])
        key = sums[word_starts[1:]] - sums[word_starts[:-1]]
    return key.view(np.int64), shingle, segment, hashes, word_starts


def _kinds(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many different words every line has."""
    line = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(hashes, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    return np.bincount(line[order][fresh], minlength=len(starts) - 1)


def _different(shingle: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of every segment, in order of segments."""
    order = np.lexsort((shingle, segment))
    shingle, segment = shingle[order], segment[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (shingle[1:] != shingle[:-1]) | (segment[1:] != segment[:-1])
    return shingle[fresh], segment[fresh]


def _lists(shingle: np.ndarray, segment: np.ndarray, segments: int) -> list[np.ndarray]:
    """Different shingles of every segment."""
    bounds = np.searchsorted(segment, np.arange(segments + 1))
    return [np.unique(shingle[a:b]) for a, b in zip(bounds, bounds[1:])]


def _cores(lines: list[str], own: list[np.ndarray]) -> list[np.ndarray]:
    """Of each trusted line's shingles, those that no part of it beside the residue has."""
    # where no pattern matched, the whole line is what makes it residue
    parts = [beside_residue(line) for line in lines]
    parts = [[] if p == [line] else p for p, line in zip(parts, lines)]
    owner = np.repeat(np.arange(len(lines)), [len(p) for p in parts])
    _, shingle, segment, *_ = _classes(pa.array([part for p in parts for part in p], pa.string()))
    beside = _lists(shingle, owner[segment], len(lines))
    return [np.setdiff1d(a, b, assume_unique=True) for a, b in zip(own, beside)]


def _nested(value: np.ndarray, segment: np.ndarray, segments: int) -> pa.Array:
    """List array of the values of every segment."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(segment, np.arange(segments + 1)), pa.int32()), pa.array(value.view(np.int64)))


def _array(lists: list[np.ndarray]) -> pa.Array:
    return pa.array([a.view(np.int64) for a in lists], pa.list_(pa.int64()))


class _Uses:
    """Uses of every word, and those in lines with a word of the standard passage, added up over a task."""

    def __init__(self):
        self.seeds = np.sort(_masked(pa.array(LATIN))[0])
        self.word, self.sums = np.zeros(0, np.uint64), np.zeros((0, 2), np.int64)

    def add(self, hashes: np.ndarray, line: np.ndarray, lines: int) -> None:
        beside = np.zeros(lines, bool)
        beside[line[np.isin(hashes, self.seeds)]] = True
        fresh, place = np.unique(hashes, return_inverse=True)
        counts = np.stack([np.bincount(place, minlength=len(fresh)), np.bincount(place[beside[line]], minlength=len(fresh))], 1)
        word, place = np.unique(np.concatenate([self.word, fresh]), return_inverse=True)
        sums = np.zeros((len(word), 2), np.int64)
        sums[place[: len(self.word)]] = self.sums
        sums[place[len(self.word) :]] += counts
        self.word, self.sums = word, sums

    def rows(self) -> pa.RecordBatch:
        """One row for each word, in the columns of `segments`; the uses stand where lines have their shingles."""
        n = len(self.word)
        used = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 2, pa.int32()), pa.array(self.sums.ravel()))
        columns = [pa.nulls(n, pa.int64()), pa.array(self.word.view(np.int64)), pa.nulls(n, pa.bool_()), used, pa.nulls(n, pa.list_(pa.int64()))]
        self.word, self.sums = self.word[:0], self.sums[:0]
        return pa.RecordBatch.from_arrays(columns, names=_SEGMENTS)


_SEGMENTS = ["doc_id", "class", "label", "shingles", "core"]


def placeholder_latin(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A filter of the words of placeholder Latin: those that mostly stand in lines with words of the standard passage."""
    counted = rows.where("doc_id is null").groupBy("class").agg(F.sum(F.get("shingles", F.lit(0))).alias("uses"), F.sum(F.get("shingles", F.lit(1))).alias("beside"))
    latin = cut(counted.where((F.col("beside") >= BESIDE * F.col("uses")) & (F.col("beside") >= USES)).select(F.array("class").alias("word")))
    return shingle_filter(latin, "word")


def segments(documents: DataFrame) -> DataFrame:
    """(doc_id, class, label, shingles, core) of every line; label: it is trusted residue, and only then are there lists.

    Rows without doc_id are words (class) with their uses, counted in the same pass; see `placeholder_latin`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses = _Uses()
        for batch in C.slices(batches):
            lines, doc = _lines(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False))
            if not len(lines):
                continue
            key, shingle, segment, hashes, starts = _classes(lines)
            uses.add(hashes, np.repeat(np.arange(len(lines)), np.diff(starts)), len(lines))
            if len(uses.word) > HELD_WORDS:
                yield uses.rows()
            label, quoted = trusted(lines, np.diff(starts), _kinds(hashes, starts))
            # a message is trusted where a document holds little else
            message = pc.match_substring_regex(lines, _MESSAGE).to_numpy(zero_copy_only=False) & ~quoted & (np.diff(starts) <= MESSAGE_WORDS)
            size = pc.utf8_length(lines).to_numpy(zero_copy_only=False)
            _, own = np.unique(doc, return_inverse=True)
            share = np.bincount(own, size * (label | message)) / np.maximum(np.bincount(own, size), 1)
            label |= message & (share[own] >= ALONE)
            key = _apart(key, quoted)
            at = np.flatnonzero(label)
            place = np.cumsum(label) - 1
            kept = label[segment]
            own_lists = _lists(shingle[kept], place[segment[kept]], len(at))
            cores = _cores(lines.take(pa.array(at)).to_pylist(), own_lists) if len(at) else []
            # null for the other lines
            rows = pa.array(np.where(label, place, 0), mask=~label)
            columns = [pa.array(doc, pa.int64()), pa.array(key), pa.array(label), _array(own_lists).take(rows), _array(cores).take(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=_SEGMENTS)
        yield uses.rows()

    return _given(documents).mapInArrow(run, "doc_id bigint, class bigint, label boolean, shingles array<bigint>, core array<bigint>")


def _apart(key: np.ndarray, quoted: np.ndarray) -> np.ndarray:
    """Classes of lines that quote are other classes than those of the same words unquoted."""
    return np.where(quoted, key ^ np.int64(0x5BD1E9955BD1E995), key)


def _given(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null and doc_id is not null").select("doc_id", "text")


def _probes(shingle: np.ndarray, exponent: int) -> Iterator[np.ndarray]:
    """The bits of every shingle in a filter of 2^exponent bits."""
    for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        mixed = (shingle ^ (shingle >> np.uint64(32))) * np.uint64(odd)
        yield ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(64 - exponent)


def shingle_filter(lists: DataFrame, name: str, each: int = FILTER_BITS) -> tuple[np.ndarray, int]:
    """(bytes, exponent) of a filter that lets all shingles of the column of lists pass and few others; the driver gets bits only."""
    total = lists.select(F.sum(F.size(name))).first()[0] or 0
    exponent = int(min(LARGEST_FILTER, max(10, np.ceil(np.log2(max(1, total) * each)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << exponent, bool)
        for batch in batches:
            for probe in _probes(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64), exponent):
                bits[probe] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    held = np.zeros(1 << (exponent - 3), np.uint8)
    for row in lists.select(name).coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        held |= np.frombuffer(row.bits, np.uint8)
    return held, exponent


def passes(shingle: np.ndarray, held: np.ndarray, exponent: int) -> np.ndarray:
    """Which shingles pass the filter."""
    out = np.ones(len(shingle), bool)
    for probe in _probes(shingle, exponent):
        out &= (held[probe >> np.uint64(3)] >> (probe & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def table_keys(simhash: np.ndarray, core: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """(cores, tables) keys in the SimHash tables, partitioned by core shingle: one for each core shingle of a segment and every two blocks."""
    block = [(simhash >> np.uint64(i * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1) for i in range(BLOCKS)]
    slots = np.stack([np.uint64(i * BLOCKS + j) << np.uint64(2 * BLOCK_BITS) | block[i] << np.uint64(BLOCK_BITS) | block[j] for i in range(BLOCKS) for j in range(i)], 1)
    slots = (slots + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    slots ^= slots >> np.uint64(29)
    return core[:, None] ^ slots[segment]


def touched(documents: DataFrame, frontier: DataFrame, latin: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """(class, simhash, shingles, hits) of every class that shares a core shingle (hits) and a SimHash table with a class of the frontier,
    and has SIMILARITY of its shingles among the frontier's; to these alone labels can pass.

    With a filter of placeholder Latin, classes of lines written in it come out too, without lists.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = batch.column(1)
            owner = pc.list_parent_indices(core).to_numpy(zero_copy_only=False)
            keys = table_keys(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), core.flatten().to_numpy(zero_copy_only=False).view(np.uint64), owner)
            width = BLOCKS * (BLOCKS - 1) // 2
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * width, pa.int32()), pa.array(keys.ravel().view(np.int64)))], names=["key"])

    keys = cut(frontier.select("simhash", "core").mapInArrow(keyed, "key array<bigint>"))
    filters = documents.sparkSession.sparkContext.broadcast([shingle_filter(frontier, "core"), shingle_filter(frontier, "shingles"), shingle_filter(keys, "key", TABLE_BITS), latin])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, whole, tables, foreign = filters.value
        for batch in C.slices(batches):
            lines, _ = _lines(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False))
            if not len(lines):
                continue
            key, shingle, segment, hashes, starts = _classes(lines)
            inside = passes(shingle, *core)
            hit = np.zeros(len(lines), bool)
            hit[segment[inside]] = True
            at = np.flatnonzero(hit)
            some = lines.take(pa.array(at))
            # lines that quote are told from what they quote and take no label
            at = at[~trusted(some, *[np.zeros(len(some), np.int64)] * 2)[1]]
            at = at[np.unique(key[at], return_index=True)[1]]
            hit = np.zeros(len(lines), bool)
            hit[at] = True
            held, owner = _different(shingle[hit[segment]], segment[hit[segment]])
            share = np.bincount(owner[passes(held, *whole)], minlength=len(lines)) >= SIMILARITY * np.bincount(owner, minlength=len(lines)) - 1e-9
            keep = share[owner]
            held, owner = held[keep], owner[keep]
            # numbered anew: those that are left
            own, owner = np.unique(owner, return_inverse=True)
            sim = simhash(held, owner, len(own))
            cored = passes(held, *core)
            met = np.zeros(len(own), bool)
            keyed_ = table_keys(sim, held[cored], owner[cored])
            met[owner[cored][passes(keyed_.ravel(), *tables).reshape(keyed_.shape).any(axis=1)]] = True
            keep = met[owner]
            held, cored, owner = held[keep], cored[keep], (np.cumsum(met) - 1)[owner[keep]]
            columns = [pa.array(key[own][met]), pa.array(sim[met].view(np.int64)), _nested(held, owner, int(met.sum())), _nested(held[cored], owner[cored], int(met.sum()))]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "simhash", "shingles", "hits"])
            if foreign is not None:
                line = np.repeat(np.arange(len(lines)), np.diff(starts))
                words_in = np.diff(starts)
                told = key[(words_in >= LEAST_WORDS) & (np.bincount(line[passes(hashes, *foreign)], minlength=len(lines)) >= LATIN_SHARE * words_in)]
                n = len(told)
                yield pa.RecordBatch.from_arrays([pa.array(told), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=["class", "simhash", "shingles", "hits"])

    return _given(documents).mapInArrow(run, "class bigint, simhash bigint, shingles array<bigint>, hits array<bigint>")


def _simhashes(lists: list[np.ndarray]) -> np.ndarray:
    """SimHash of each list of different shingles."""
    segment = np.repeat(np.arange(len(lists)), [len(a) for a in lists])
    return simhash(np.concatenate([*lists, np.zeros(0, np.uint64)]).astype(np.uint64), segment, len(lists)).view(np.int64)


def with_simhash(frontier: DataFrame) -> DataFrame:
    """`frontier`(class, shingles, core) with its simhash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(a, np.int64).view(np.uint64) for a in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_simhashes(lists))], names=["class", "shingles", "core", "simhash"])

    return frontier.select("class", "shingles", "core").mapInArrow(run, "class bigint, shingles array<bigint>, core array<bigint>, simhash bigint")


def _similar(a: str, b: str) -> Column:
    """The two lists of different shingles are near-duplicates."""
    return F.size(F.array_intersect(a, b)) >= SIMILARITY * F.size(F.array_union(a, b)) - 1e-9


def near_duplicates(frontier: DataFrame, open_: DataFrame) -> DataFrame:
    """(class, core) of the classes of `open_` that are near-duplicates of classes of `frontier` and share a shingle of their core.

    What the SimHash tables brought meets by core shingle; then Hamming distance, number of shingles and SIMILARITY are asked. core: what
    they share of the cores.
    """
    given = frontier.select(F.col("class").alias("from"), F.size("shingles").alias("from_size"), F.col("simhash").alias("from_hash"), F.explode("core").alias("slot"))
    asked = open_.select("class", F.size("shingles").alias("size"), "simhash", F.explode("hits").alias("slot"))
    near = F.bit_count(F.col("simhash").bitwiseXOR(F.col("from_hash"))) <= HAMMING
    alike = (F.col("size") >= SIMILARITY * F.col("from_size") - 1e-9) & (F.col("from_size") >= SIMILARITY * F.col("size") - 1e-9)
    met = asked.join(given, "slot").where(near & alike & (F.col("class") != F.col("from"))).select("class", "from").distinct()
    sources = frontier.select(F.col("class").alias("from"), F.col("shingles").alias("a"), F.col("core").alias("held"))
    pairs = met.join(sources, "from").join(open_.select("class", "shingles"), "class").where(_similar("a", "shingles"))
    found = pairs.select("class", F.explode(F.array_intersect("held", "shingles")).alias("shingle")).groupBy("class").agg(F.collect_set("shingle").alias("core"))
    return found


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of each document with residue. Null, empty and blank texts and rows without doc_id are none; equal texts each give their row."""
    rows = cut(segments(documents))
    lines = rows.where("doc_id is not null").select("doc_id", "class", "label", "shingles", "core")
    frontier = cut(with_simhash(lines.where("label").select("class", "shingles", "core").dropDuplicates(["class"])))
    labelled, latin = frontier.select("class"), placeholder_latin(rows)
    while True:
        met = cut(touched(documents, frontier, latin))
        if latin is not None:
            labelled, latin = cut(labelled.unionAll(met.where("shingles is null").select("class")).distinct()), None
        open_ = met.where("shingles is not null").join(labelled.hint("merge"), "class", "left_anti").dropDuplicates(["class"])
        found = near_duplicates(frontier, open_)
        frontier = cut(open_.select("class", "shingles", "simhash").join(found, "class").select("class", "shingles", "core", "simhash"))
        if frontier.isEmpty():
            break
        labelled = cut(labelled.unionAll(frontier.select("class")))
    return lines.join(labelled, "class", "left_semi").select("doc_id").distinct()
