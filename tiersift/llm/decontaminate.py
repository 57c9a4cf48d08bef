"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items by block-max WAND.

The index holds the items' distinct words in postings cut at common item numbers into blocks, and for each word and block the
largest impact. Impacts are divided by an item's score for its own text, so one threshold serves all items.
Items are grouped by length, in powers of two from 32 words; passages have twice the words of the group's limit and overlap by half, so that
an item of any length lies whole in one and no long item loosens the test of a short one. For all passages of a chunk at once, blocks whose summed largest
impacts stay below the threshold are skipped; WAND goes through the others item by item. All items at or above the
threshold are retrieved, none is cut off, and a hit counts only if the passage has most words of the
item's question and most of its answer.

Question and answer of an item are its text before and after the last line break, or its halves by words when it has
one line. Edge cases: null and empty texts have no passages, items without words are never found, repeated rows
are reported as often as they occur, long texts are searched whole, passage by passage, an empty table gives an empty result. The index goes to every task: its size is
checked against ``MAX_INDEX_WORDS``, beyond which the items are searched in several parts, one pass over the texts each, with counts of words taken over all items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersift.llm.words import PUNCTUATION, Words, lowered, text_chunks

K1, B = 1.2, 0.75
BLOCK = 8  # items of a block; more if the table of largest impacts would pass TABLE numbers
TABLE = 1 << 25
THRESHOLD, OVERLAP = 0.65, 0.8
MAX_INDEX_WORDS = 4_000_000
RESULT = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    found = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    for _, _, data, offsets in text_chunks(batch, "text"):
        words = Words(lowered(data), offsets, PUNCTUATION)
        h = words.hashes()
        found += [h[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    return found


@dataclass
class Counts:
    """Of the whole benchmark: in how many items each word is, how many items and words there are."""
    terms: np.ndarray  # sorted word hashes
    df: np.ndarray
    n_items: int = 0
    n_words: int = 0

    @classmethod
    def none(cls) -> Counts:
        return cls(np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def plus(self, texts: list[str | None]) -> Counts:
        whole = _hashes(texts)
        each = np.concatenate([self.terms, *[np.unique(w) for w in whole]])
        terms, at = np.unique(each, return_inverse=True)
        df = np.bincount(at, weights=np.append(self.df, np.ones(len(each) - len(self.df))), minlength=len(terms))
        return Counts(terms, df.astype(np.int64), self.n_items + len(whole), self.n_words + sum(map(len, whole)))


def _limit(n_words: int) -> int:
    """Most words of an item in the group of one with so many."""
    return max(32, 1 << max(n_words - 1, 0).bit_length())


def _halves(text: str | None) -> tuple[str, str]:
    text = (text or "").strip()
    head, _, tail = text.rpartition("\n")
    if head.strip():
        return head, tail
    words = text.split()
    return " ".join(words[:len(words) // 2]), " ".join(words[len(words) // 2:])


@dataclass
class Index:
    ids: list[int]
    question: list[np.ndarray]  # distinct words, sorted
    answer: list[np.ndarray]
    terms: np.ndarray  # sorted word hashes
    bounds: np.ndarray  # postings of term i: bounds[i]:bounds[i+1]
    items: np.ndarray  # ascending within a term
    impacts: np.ndarray
    block: int  # items per block
    largest: np.ndarray  # largest impact by term and block
    passage: int  # words of a passage; the step is half of it

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], counts: Counts | None = None, passage: int | None = None) -> Index:
        halves = [_halves(t) for _, t in items]
        whole = _hashes([t for _, t in items])
        longest = max((len(w) for w in whole), default=0)
        entries, lengths = [], np.array([len(w) for w in whole], dtype=float)
        counts = counts or Counts.none().plus([t for _, t in items])
        mean = counts.n_words / counts.n_items if counts.n_items else 1.0
        for i, w in enumerate(whole):
            term, tf = np.unique(w, return_counts=True)
            entries.append((term, np.full(len(term), i), tf))
        term = np.concatenate([e[0] for e in entries] or [np.zeros(0, np.uint64)])
        item = np.concatenate([e[1] for e in entries] or [np.zeros(0, int)]).astype(np.int64)
        tf = np.concatenate([e[2] for e in entries] or [np.zeros(0)]).astype(float)
        order = np.lexsort((item, term))
        term, item, tf = term[order], item[order], tf[order]
        terms, first, df = np.unique(term, return_index=True, return_counts=True)
        in_all = counts.df[np.searchsorted(counts.terms, terms)]
        idf = np.repeat(np.log1p((counts.n_items - in_all + 0.5) / (in_all + 0.5)), df)
        impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / max(mean, 1e-9)))
        own = np.bincount(item, weights=impact, minlength=len(items))
        impact = impact / own[item]
        block = max(BLOCK, -(-len(items) * len(terms) // TABLE))
        largest = np.zeros((len(terms), -(-len(items) // block)), dtype=np.float32)
        np.maximum.at(largest, (np.repeat(np.arange(len(terms)), df), item // block), impact * (1 + 1e-6))
        return cls([i for i, _ in items], [np.unique(h) for h in _hashes([q for q, _ in halves])],
                   [np.unique(h) for h in _hashes([a for _, a in halves])], terms,
                   np.append(first, len(item)), item, impact, block, largest, passage or 2 * max(longest, 32))

    def search(self, query: np.ndarray, block: int, threshold: float) -> list[tuple[int, float]]:
        """All items of a block with score >= threshold for the distinct terms (numbers) of a passage: WAND.

        One cursor per term; the pivot is the first item at which the largest impacts of the terms up to it reach the threshold.
        Cursors before the pivot jump to it, and it is scored when all stand on it.
        """
        low, end = block * self.block, (block + 1) * self.block
        lists, tops = [], []
        for term, top in zip(query.tolist(), self.largest[query, block].tolist(), strict=True):
            if top > 0:
                a, b = self.bounds[term], self.bounds[term + 1]
                i, j = np.searchsorted(self.items[a:b], (low, end)) + a
                lists.append([*zip(self.items[i:j].tolist(), self.impacts[i:j].tolist(), strict=True), (end, 0.0)])
                tops.append(top)
        at, found = [0] * len(lists), []
        while True:
            live = sorted((x[i][0], t) for t, (x, i) in enumerate(zip(lists, at, strict=True)) if x[i][0] < end)
            bound, pivot = 0.0, None
            for item, t in live:
                bound += tops[t]
                if bound >= threshold:
                    pivot = item
                    break
            if pivot is None:
                return found
            if live[0][0] == pivot:
                score = 0.0
                for item, t in live:
                    if item == pivot:
                        score += lists[t][at[t]][1]
                        at[t] += 1
                if score >= threshold - 1e-12:
                    found.append((pivot, score))
            else:
                for item, t in live:
                    while item < pivot:
                        at[t] += 1
                        item = lists[t][at[t]][0]

    def overlap(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Share of the question's and of the answer's distinct words found among sorted distinct ``passage`` words."""
        shares = []
        for part in (self.question[item], self.answer[item]):
            shares.append(float(np.isin(part, passage, assume_unique=True).mean()) if len(part) else 1.0)
        return shares[0], shares[1]


def _candidates(words: Words, hashes: np.ndarray, index: Index, threshold: float):
    """Text number, passage number, distinct terms and block, wherever a block's largest impacts reach the threshold.

    A passage is two neighbouring steps of words; its terms are counted once.
    """
    near = np.zeros(1 << 16, dtype=bool)
    near[(index.terms >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(near[(hashes >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.terms, hashes[maybe]), len(index.terms) - 1)
    hit = index.terms[place] == hashes[maybe]
    at, term = maybe[hit], place[hit]
    step, low = index.passage // 2, words.bounds[:-1]
    steps = np.maximum(-(-np.diff(words.bounds) // step), 1)
    first = np.cumsum(steps) - steps  # number of a text's first step
    text = np.searchsorted(words.bounds, at, "right") - 1
    own = first[text] + (at - low[text]) // step
    earlier = own > first[text]  # the word is also in the passage that began one step before
    key = np.concatenate([own, own[earlier] - 1]) * len(index.terms) + np.concatenate([term, term[earlier]])
    key = np.unique(key)
    passage, term = key // len(index.terms), key % len(index.terms)
    cut = np.flatnonzero(np.diff(passage, prepend=-1))
    for i in range(0, len(cut), 4096):
        a, b = cut[i], cut[i + 4096] if i + 4096 < len(cut) else len(term)
        sums = np.add.reduceat(index.largest[term[a:b]], cut[i:i + 4096] - a, axis=0)
        for row, block in zip(*np.nonzero(sums >= threshold), strict=True):
            c = i + row
            query = term[cut[c]:cut[c + 1] if c + 1 < len(cut) else len(term)]
            owner = int(np.searchsorted(first, passage[cut[c]], "right")) - 1
            yield owner, int(passage[cut[c]] - first[owner]), query, int(block)


def _search_texts(documents: DataFrame, indexes: list[Index], threshold: float, overlap: float) -> DataFrame:
    def work(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for row, _, data, offsets in text_chunks(batch, "text"):
                words = Words(lowered(data), offsets, PUNCTUATION)
                hashes = words.hashes()
                for index in indexes:
                    step = index.passage // 2
                    for text, number, query, block in _candidates(words, hashes, index, threshold):
                        for item, score in index.search(query, block, threshold):
                            low = words.bounds[text] + number * step
                            own = np.unique(hashes[low:min(low + 2 * step, words.bounds[text + 1])])
                            shares = index.overlap(item, own)
                            if min(shares) >= overlap:
                                rows.append((ids[row + text], index.ids[item], number, score, *shares))
            kinds = (pa.int64(),) * 3 + (pa.float64(),) * 3
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, RESULT)


def leaks(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
          max_words: int = MAX_INDEX_WORDS) -> DataFrame:
    """``doc_id, item_id, passages, score, question_overlap, answer_overlap`` of every leaked item of every text."""
    sized = benchmark.filter("item_id IS NOT NULL").select(
        F.col("item_id").cast("long"), "text", F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n"))
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-total // max_words))
    def items_of(part: int) -> list[tuple[int, str | None]]:
        items = sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).select("item_id", "text").distinct()
        return sorted((tuple(r) for r in items.collect()), key=lambda r: (r[0], r[1] or ""))

    counts, items = Counts.none(), []
    for part in range(parts):
        items = items_of(part)
        counts = counts.plus([t for _, t in items])
    result = None
    for part in range(parts):  # one unless the benchmark outgrows what a task may hold
        groups: dict[int, list] = {}
        items = items if parts == 1 else items_of(part)
        for item, words in zip(items, _hashes([t for _, t in items]), strict=True):
            groups.setdefault(_limit(len(words)), []).append(item)
        indexes = [Index.build(groups[limit], counts, 2 * limit) for limit in sorted(groups)]
        indexes = [x for x in indexes if len(x.terms)]
        if indexes:
            found = _search_texts(documents, indexes, threshold, overlap)
            result = found if result is None else result.unionByName(found)
    if result is None:
        return documents.sparkSession.createDataFrame([], RESULT).withColumnRenamed("passage", "passages")
    return result.groupBy("doc_id", "item_id").agg(
        F.countDistinct("passage").alias("passages"), F.max("score").alias("score"),
        F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"))
