"""Evaluation texts leaking into training text (problem 7): an FM-index per shard, searched for the phrases of the test items.

Every task indexes the texts of its partition in shards of bounded size and searches all phrases of all items in them; nothing is
shuffled. What the items hold (a fixed table) is the only thing sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vankho.llm import codepoints as C
from vankho.llm.fm_index import FMIndex
from vankho.llm.words import words

#: Words of a test phrase.
PHRASE = 3
#: Share of an item's words that makes a leak.
SHARE = 1 / 3
#: A chain is a leak if its hits cover this share of its words; chains of other items of the same making cover less.
DENSITY = 0.75
#: Hits may drift this many words from one another (words added or left out), and lie this many words apart.
DRIFT, GAP = 8, 12
#: Code points of a shard.
SHARD = 6_000_000
#: Hits that are looked at together.
HITS = 2_000_000
#: The items are a fixed small table; more than this and they must not be sent to every task.
MAX_ITEMS = 20_000


@dataclass
class Phrases:
    """Test items as symbols: vocabulary hashes (sorted), distinct phrases, and where each stands."""

    vocabulary: np.ndarray
    bits: int
    phrases: np.ndarray
    owner: np.ndarray
    item: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    lengths: np.ndarray


def phrases_of(items: list[tuple[int, str]]) -> Phrases:
    """All phrases of the items, distinct, with the items and places that have them (sorted by phrase)."""
    texts = pa.array([t or "" for _, t in items], pa.string())
    hashes, _, starts = words(*C.decode(texts))
    vocabulary, symbols = np.unique(hashes, return_inverse=True)
    symbols = symbols + 1
    bits = max(1, int(len(vocabulary)).bit_length())
    rows, item, place = [], [], []
    for i in range(len(items)):
        own = symbols[starts[i] : starts[i + 1]]
        for p in range(len(own) - PHRASE + 1):
            rows.append(own[p : p + PHRASE])
            item.append(i)
            place.append(p)
    stacked = np.array(rows, np.int64).reshape(-1, PHRASE)
    distinct, owner = np.unique(stacked, axis=0, return_inverse=True)
    order = np.argsort(owner.ravel(), kind="stable")
    return Phrases(
        vocabulary, bits, distinct, owner.ravel()[order], np.array(item, np.int64)[order], np.array(place, np.int64)[order],
        np.array([i for i, _ in items], np.int64), np.diff(starts),
    )


def _symbols(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at + 1, 0)


def search_shard(cp: np.ndarray, starts: np.ndarray, p: Phrases) -> dict[str, np.ndarray]:
    """Leaks in one shard: text number, item number, and the first and last word (exclusive) with their places in `cp`."""
    hashes, begin, word_starts = words(cp, starts)
    none = {k: np.zeros(0, np.int64) for k in ("text", "item", "first", "last", "held")}
    if not len(hashes) or not len(p.vocabulary):
        return none
    symbols = _symbols(hashes, p.vocabulary)
    # a 0 after each text; runs of words that no item has become one 0
    text = np.repeat(np.arange(len(word_starts) - 1), np.diff(word_starts))
    spread = np.zeros(len(symbols) + len(word_starts) - 1, np.int64)
    slot = np.arange(len(symbols)) + text
    spread[slot] = symbols
    word = np.full(len(spread), -1, np.int64)
    word[slot] = np.arange(len(symbols))
    kept = np.ones(len(spread), bool)
    kept[1:] = (spread[1:] != 0) | (spread[:-1] != 0)
    kept[-1] = True
    spread, word = spread[kept], word[kept]
    if spread[-1] != 0:
        spread, word = np.append(spread, 0), np.append(word, -1)
    index = FMIndex(spread, p.bits)
    low, high = index.search(p.phrases)
    counts = high - low
    total = int(counts.sum())
    if not total:
        return none
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total)
    phrase = np.repeat(np.arange(len(counts)), counts)
    at = word[index.locate(rows)]
    # every item that has the phrase, in parts of bounded size: a part holds whole texts, or one text and a range of items
    left = np.searchsorted(p.owner, np.arange(len(counts)))
    many = np.searchsorted(p.owner, np.arange(len(counts)), "right") - left
    order = np.argsort(text[at], kind="stable")
    at, phrase = at[order], phrase[order]
    found = [_chains(*hits, p, none) for hits in _parts(at, text[at], phrase, left, many, p)]
    return {k: np.concatenate([f[k] for f in found]) for k in none}


def _parts(at: np.ndarray, text: np.ndarray, phrase: np.ndarray, left: np.ndarray, many: np.ndarray, p: Phrases) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, item, word, place) of all hits, about HITS at a time; hits of one text and item are always together."""
    begin = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    end = np.append(begin[1:], len(text))
    total = np.concatenate([[0], np.cumsum(many[phrase])])
    i = 0
    while i < len(begin):
        # whole texts that fit, at least one
        j = max(i + 1, int(np.searchsorted(total[end], total[begin[i]] + HITS, "right")))
        rows = slice(begin[i], end[j - 1])
        ranges = max(1, -(-int(total[end[j - 1]] - total[begin[i]]) // HITS))
        bounds = np.linspace(0, len(p.ids), min(ranges, len(p.ids)) + 1).astype(np.int64)
        for low, high in zip(bounds, bounds[1:]):
            # items stand in order within a phrase
            base = phrase[rows] * len(p.ids)
            key = p.owner * len(p.ids) + p.item
            first, last = np.searchsorted(key, base + low), np.searchsorted(key, base + high)
            size = last - first
            source = np.repeat(np.arange(len(size)), size)
            entry = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            yield text[rows][source], p.item[entry], at[rows][source], p.place[entry]
        i = j


def _chains(text: np.ndarray, item: np.ndarray, word: np.ndarray, place: np.ndarray, p: Phrases, none: dict) -> dict[str, np.ndarray]:
    """Hits of one text and item that lie near one diagonal and near one another form a chain; a chain that holds enough words is a leak."""
    pair = text * len(p.ids) + item
    shift = word - place
    # pairs with too few hits to hold enough words go at once: a hit brings at most PHRASE words
    need = np.maximum(1, np.floor(p.lengths * SHARE * 0.5 / PHRASE)).astype(np.int64)
    distinct, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
    good = (count >= need[distinct % len(p.ids)])[inverse]
    text, item, word, place, pair, shift = (x[good] for x in (text, item, word, place, pair, shift))
    if not len(pair):
        return none
    order = np.lexsort((word, shift, pair))
    pair, shift = pair[order], shift[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (shift[1:] - shift[:-1] > DRIFT)
    band = np.cumsum(fresh)
    again = np.lexsort((place[order], word[order], band))
    order, band = order[again], band[again]
    word, place, item, text = word[order], place[order], item[order], text[order]
    fresh = np.ones(len(band), bool)
    fresh[1:] = (band[1:] != band[:-1]) | (word[1:] - word[:-1] > GAP)
    chain = np.cumsum(fresh) - 1
    chains = int(chain[-1]) + 1
    # words of the item that the chain's hits cover, each once
    width = int(p.lengths.max()) + PHRASE
    cover = np.unique((chain[:, None] * width + place[:, None] + np.arange(PHRASE)).ravel())
    held = np.bincount(cover // width, minlength=chains)
    first_place = np.minimum.reduceat(place, np.flatnonzero(fresh))
    last_place = np.maximum.reduceat(place, np.flatnonzero(fresh)) + PHRASE
    first = np.minimum.reduceat(word, np.flatnonzero(fresh))
    last = np.maximum.reduceat(word, np.flatnonzero(fresh)) + PHRASE
    at = np.flatnonzero(fresh)
    span = last_place - first_place
    enough = (np.minimum(span, last - first) >= p.lengths[item[at]] * SHARE - 1) & (held >= DENSITY * np.maximum(span, last - first - DRIFT))
    return {"text": text[at][enough], "item": item[at][enough], "first": first[enough], "last": last[enough], "held": held[enough]}


def find_leaks(documents: DataFrame, items: DataFrame, spans: bool = False) -> DataFrame:
    """(doc_id, item_id) of every document that holds a third of an item's words in one place and in order.

    spans: instead (doc_id, begin, end, item_ids), the merged character spans to remove. Null and empty texts and rows without doc_id give
    no row, an empty table of items none at all; equal texts each give their own rows.
    """
    rows = items.select("item_id", "item_text").where("item_id is not null and item_text is not null").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items")
    wanted = phrases_of([(r.item_id, r.item_text) for r in rows])

    def shard(ids: list[np.ndarray], columns: list[pa.Array]) -> pa.RecordBatch:
        cp, starts = C.decode(pa.concat_arrays(columns))
        doc = np.concatenate(ids)
        found = search_shard(cp, starts, wanted)
        if not spans:
            pair = np.unique(np.stack([doc[found["text"]], wanted.ids[found["item"]]], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0], pa.int64()), pa.array(pair[:, 1], pa.int64())], names=["doc_id", "item_id"])
        return _merged(found, cp, starts, doc, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, columns, size = [], [], 0
        for batch in batches:
            done = 0
            text = batch.column(1).cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
            while done < len(text):
                # as many texts as fit, at least one: a long text is never cut
                fits = max(done + 1, int(np.searchsorted(ends, ends[done] + SHARD - size, "right")) - 1)
                ids.append(batch.column(0).slice(done, fits - done).to_numpy(zero_copy_only=False))
                columns.append(text.slice(done, fits - done))
                size += int(ends[fits] - ends[done])
                done = fits
                if size >= SHARD or done < len(text):
                    yield shard(ids, columns)
                    ids, columns, size = [], [], 0
        if columns:
            yield shard(ids, columns)

    schema = "doc_id bigint, begin bigint, end bigint, item_ids array<bigint>" if spans else "doc_id bigint, item_id bigint"
    given = documents.select("doc_id", "text").where("text is not null and doc_id is not null")
    if not len(wanted.phrases):
        return documents.sparkSession.createDataFrame([], schema)
    return given.mapInArrow(run, schema)


def _merged(found: dict[str, np.ndarray], cp: np.ndarray, starts: np.ndarray, doc: np.ndarray, p: Phrases) -> pa.RecordBatch:
    """Overlapping removal spans of a text merged, with the items that each covers; begin and end in characters of the text."""
    _, begin, word_starts = words(cp, starts)
    out: list[tuple[int, int, int, list[int]]] = []
    order = np.lexsort((found["first"], found["text"]))
    for i in order:
        text, first, last, item = (int(found[k][i]) for k in ("text", "first", "last", "item"))
        left = int(begin[first] - starts[text])
        right = int((begin[last] if last < word_starts[text + 1] else starts[text + 1]) - starts[text])
        if out and out[-1][0] == text and left <= out[-1][2]:
            out[-1] = (text, out[-1][1], max(out[-1][2], right), sorted({*out[-1][3], int(p.ids[item])}))
        else:
            out.append((text, left, right, [int(p.ids[item])]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([int(doc[t]) for t, *_ in out], pa.int64()),
            pa.array([b for _, b, *_ in out], pa.int64()),
            pa.array([e for _, _, e, _ in out], pa.int64()),
            pa.array([i for *_, i in out], pa.list_(pa.int64())),
        ],
        names=["doc_id", "begin", "end", "item_ids"],
    )
