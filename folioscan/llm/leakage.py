"""Evaluation texts that leaked into a corpus, found with one generalised suffix automaton.

The held-out items are a small set: their automaton is built on the driver, its size is checked, and it is broadcast. The
corpus is only streamed past it, without a shuffle. A larger set of items is matched in several passes, one automaton after
the other, each dropped before the next.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_stage, pick
from folioscan.plans.shared import materialise

#: Words are runs of letters and digits once case, marks and compatibility forms are gone.
WORD = r"[\p{L}\p{N}]+"
MARKS = r"\p{M}+"
MIN_WORDS = 12
#: Where items also leak by coverage, runs of so many words count towards it.
SHORT_RUN = 5
#: The broadcast automaton may hold so many words of items; a larger set is matched in several passes over the corpus.
MAX_ITEM_WORDS = 400_000


def normalised(text: str | None, strip_marks, words) -> list[str]:
    """Words of ``text`` without case, punctuation, spacing and marks."""
    if not text:
        return []
    if not text.isascii():
        text = strip_marks("", unicodedata.normalize("NFKD", text))
    return words(text.lower())


class SuffixAutomaton:
    """Generalised suffix automaton over words of several items.

    ``next``: transitions, ``link``: suffix links, ``length``: longest string of a state, ``ends``: items with an
    occurrence of the state's strings, and where the first ends (filled from longer to shorter states).
    """

    def __init__(self, items: dict[int, list[str]]):
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[dict[int, int]] = [{}]
        for item, words in items.items():
            last = 0
            for n, word in enumerate(words, 1):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)), ends)
                ends[last].setdefault(item, n)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = ends[self.link[state]]
            if self.link[state] > 0:
                for item, n in ends[state].items():
                    up[item] = min(n, up.get(item, n))
        self.ends = [tuple(sorted(e.items())) for e in ends]

    def _new(self, length: int, ends: list[dict[int, int]]) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, c: int, ends: list[dict[int, int]]) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, ends)
        self.next[clone] = dict(self.next[q])
        self.link[clone], self.link[q] = self.link[q], clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, ends: list[dict[int, int]]) -> int:
        if c in self.next[last]:
            return self._split(last, c, ends)
        cur, p = self._new(self.length[last] + 1, ends), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        self.link[cur] = 0 if p == -1 else self._split(p, c, ends)
        return cur

    def cut_states(self, least: int) -> list[int]:
        """For each state the ancestor that holds its suffix of exactly ``least`` words, or -1 if it is shorter."""
        cut = [-1] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            if self.length[state] >= least:
                up = self.link[state]
                cut[state] = state if self.length[up] < least else cut[up]
        return cut


#: A run of words that a text and an item have in common: where it begins and ends in the text, and ends in the item.
Run = tuple[int, int, int]


def _walk(words: list[str], auto: tuple, least: int) -> dict[int, list[Run]]:
    """For each item the longest runs of at least ``least`` words that end at each word."""
    ids, step, link, length, cut, ends = auto
    state = run = 0
    get = ids.get
    found: dict[int, list[Run]] = {}
    for i, word in enumerate(words):
        c = get(word, -1)
        if c < 0:
            state = run = 0
            continue
        while True:
            to = step[state].get(c)
            if to is not None:
                state, run = to, run + 1
                break
            if not state:
                run = 0
                break
            state = link[state]
            run = length[state]
        if run >= least:
            up, told = state, set()
            while up > 0 and length[up] >= least:  # every item that shares the last `least` words or more
                here = min(run, length[up])
                for item, at in ends[up]:
                    if item not in told:
                        told.add(item)
                        runs = found.setdefault(item, [])
                        if runs and runs[-1][0] == i + 1 - here and runs[-1][1] == i:
                            runs[-1] = (i + 1 - here, i + 1, at)
                        else:
                            runs.append((i + 1 - here, i + 1, at))
                if up == cut[state]:
                    break
                up = link[up]
    return found


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as a union, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Matcher:
    """Holds texts against the items of one automaton."""

    def __init__(self, auto: tuple, sizes: dict[int, int], min_words: int, min_coverage: float | None):
        import regex

        self.auto, self.sizes, self.min_words, self.min_coverage = auto, sizes, min_words, min_coverage
        self.least = min_words if min_coverage is None else min(SHORT_RUN, min_words)
        self.strip_marks, self.words = regex.compile(MARKS).sub, regex.compile(WORD).findall
        self.raw = regex.compile(r"[\p{L}\p{M}\p{N}]+").finditer

    def plain(self, text: str | None) -> list[str]:
        return normalised(text, self.strip_marks, self.words)

    def leaks(self, words: list[str]) -> dict[int, tuple[int, float, list[Run]]]:
        """For each item that leaked its longest run, the share of its words that runs cover, and the runs."""
        out = {}
        for item, runs in _walk(words, self.auto, self.least).items():
            longest = max(b - a for a, b, _ in runs)
            held = sum(b - a for a, b in _united([(at - (b - a), at) for a, b, at in runs]))
            coverage = min(1.0, held / self.sizes[item])
            if longest >= self.min_words or (self.min_coverage is not None and coverage >= self.min_coverage):
                out[item] = longest, coverage, runs
        return out

    def spans(self, text: str, words: list[str]) -> list[tuple[int, int]]:
        """Where in ``text``, whose words are ``words``, leaked items stand, in characters."""
        leaks = self.leaks(words)
        if not leaks:
            return []
        places = [(w, m.start(), m.end()) for m in self.raw(text) for w in self.plain(m.group())]
        if len(places) != len(words):  # forms that join or split under normalisation: match on the runs of letters themselves
            leaks = self.leaks([w for w, _, _ in places])
        return [(places[a][1], places[b - 1][2]) for _, _, runs in leaks.values() for a, b, _ in runs]


def _item_passes(items: DataFrame, item_id: str, item_text: str, least: int) -> Iterator[tuple[tuple, dict[int, int], bool]]:
    """Automata of at most ``MAX_ITEM_WORDS`` words (more only for a single item), the words of each item, and whether it's the last.

    The items come one by one; a pass holds its own only. An item of several texts is in one pass, its size that of the longest.
    """
    import regex

    strip_marks, words = regex.compile(MARKS).sub, regex.compile(WORD).findall

    def built(group: dict[int, list[str]]) -> tuple:
        a = SuffixAutomaton(group)
        return a.ids, a.next, a.link, a.length, a.cut_states(least), a.ends

    group: dict[int, list[str]] = {}
    sizes: dict[int, int] = {}
    held = 0
    for row in pick(items, i=item_id, t=item_text).where("i is not null and t is not null").distinct().orderBy("i", "t").toLocalIterator():
        found = normalised(row.t, strip_marks, words)
        if held + len(found) > MAX_ITEM_WORDS and group and row.i not in group:
            yield built(group), sizes, False
            group, sizes, held = {}, {}, 0
        held += len(found)
        # another text under the same id: the sentinel is no word, so no run crosses it
        group[row.i] = [*group[row.i], "\0", *found] if row.i in group else found
        sizes[row.i] = max(sizes.get(row.i, 1), len(found))
    yield built(group), sizes, True


def _least(min_words: int, min_coverage: float | None) -> int:
    return min_words if min_coverage is None else min(SHORT_RUN, min_words)


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    min_coverage: float | None = None,
) -> DataFrame:
    """Rows ``(doc_id, item_id, words, coverage)`` for documents that hold at least ``min_words`` consecutive words of an item.

    ``words``: the longest common run; ``coverage``: the share of the item's words that stand in common runs. With ``min_coverage``
    runs of ``SHORT_RUN`` words count towards the coverage, and a document that reaches it counts too: so short items, and items
    that come in pieces, are found. Null and empty texts match nothing; repeated document ids give one row per id
    and item, with the longest run. An item given twice under one id counts once. Further columns are ignored; empty tables
    give no rows.
    """
    spark = documents.sparkSession
    docs = pick(documents, d=doc_id, t=text).where("t is not null")
    out = None
    for auto, sizes, last in _item_passes(items, item_id, item_text, _least(min_words, min_coverage)):
        shared = spark.sparkContext.broadcast((auto, sizes))

        def stage(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value, min_words, min_coverage)
            for batch in batches:
                rows = [(d, item, longest, round(coverage, 6)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for item, (longest, coverage, _) in matcher.leaks(matcher.plain(t)).items()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "words", "coverage"])

        part = arrow_stage(docs, stage, "doc_id long, item_id long, words long, coverage double")
        if not last or out is not None:
            part = materialise(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"), F.max("coverage").alias("coverage"))


def over_cleaned(
    documents: DataFrame,
    items: DataFrame,
    emit: Callable[[Matcher], Callable[[list[tuple[int, str | None, list[tuple[int, int]], list[str]]]], pa.RecordBatch]],
    schema: str,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    min_coverage: float | None = None,
) -> DataFrame:
    """One stage over the documents with the places of leaked items: ``emit`` gets a matcher in each task, and what it returns
    makes a batch of rows ``(doc_id, text, spans, words)``, ``words`` those of the whole text."""
    spark = documents.sparkSession
    kind = "array<struct<a: int, b: int>>"
    docs = pick(documents, d=doc_id, t=text).withColumn("d", F.col("d").cast("long")).withColumn("spans", F.lit(None).cast(kind))
    spans_of = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
    for auto, sizes, last in _item_passes(items, item_id, item_text, _least(min_words, min_coverage)):
        shared = spark.sparkContext.broadcast((auto, sizes))

        def stage(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(*shared.value, min_words, min_coverage)
            told = emit(matcher) if last else None
            for batch in batches:
                rows = []
                for d, t, spans in zip(*(c.to_pylist() for c in batch.columns)):
                    words = matcher.plain(t)
                    found = [(x["a"], x["b"]) for x in spans or ()] + (matcher.spans(t, words) if t else [])
                    rows.append((d, t, _united(found), words))
                if last:
                    yield told(rows)
                else:
                    held = [[{"a": a, "b": b} for a, b in r[2]] for r in rows]
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, spans_of)], ["d", "t", "spans"])

        if last:
            return arrow_stage(docs, stage, schema)
        docs = materialise(arrow_stage(docs, stage, f"d long, t string, spans {kind}"))
        shared.destroy()
    raise AssertionError("there is always a last pass")


def kept_text(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without ``spans``."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def without_leaks(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    min_coverage: float | None = None,
    max_coverage: float = 0.8,
) -> DataFrame:
    """Rows ``(doc_id, text, removed_words, coverage, dropped)``: the documents with leaked spans taken out.

    What leaks is as in ``leaked_items``. A document of which more than ``max_coverage`` would go is marked ``dropped`` and
    gets an empty text. Null text stays null. One row per input row.
    """

    def emit(matcher: Matcher) -> Callable[[list], pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [], [])
            for d, t, spans, words in rows:
                gone = sum(len(matcher.plain(t[a:b])) for a, b in spans)
                share = min(1.0, gone / len(words)) if words else 0.0
                over = share > max_coverage
                for col, v in zip(out, (d, "" if over else kept_text(t, spans) if spans else t, gone, round(share, 6), over)):
                    col.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "text", "removed_words", "coverage", "dropped"])

        return batch

    schema = "doc_id long, text string, removed_words long, coverage double, dropped boolean"
    return over_cleaned(documents, items, emit, schema, doc_id, text, item_id, item_text, min_words, min_coverage)
