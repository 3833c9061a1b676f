"""Occurrences and records of every term (or run of up to ``max_len`` terms), by sorted suffixes.

Map tasks cut every record into suffixes of ``max_len`` terms, combine equal ones and pass them on in sorted, compressed
blocks by route: the first term and a part of the second. Each route is sorted in reverse order, and a stack of open
prefixes gives the counts of all prefixes in one pass.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import TERM, arrow_stage, pick, terms_of
from folioscan.llm.near import mix

RARE_RECORDS = 1
COMMON_SHARE = 0.1
#: Suffixes with one first term go to so many routes, by their second term: a hot first term is split.
ROUTES_PER_TERM = 16
#: Routes for each partition of a shuffle.
ROUTES = 4
#: Stands between the terms of a suffix, below all signs of a term: suffixes that share terms stay side by side in order.
BETWEEN = "\x1f"
#: Terms held by a map task before it passes their suffixes on.
HELD = 300_000
#: Suffixes unpacked at once.
UNPACKED = 50_000


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows, in order, differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.nonzero(new)[0]


def record_suffixes(codes: np.ndarray, docs: np.ndarray, max_len: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct suffixes of records cut to ``max_len`` terms, in order: ``(terms, known, n, fresh)``.

    ``codes``: the terms of record after record as numbers from 1 in their order; ``docs``: the record of each. A shorter
    suffix has 0 for what it lacks. A record's suffix is told with the number of terms, ``known``, that it shares with
    the record's suffix before it: only for the longer prefixes is the record a further one. ``n`` counts
    occurrences, ``fresh`` the records with this suffix and ``known``.
    """
    terms = []
    for k in range(max_len):
        term = np.zeros_like(codes)
        term[: len(codes) - k] = np.where(docs[k:] == docs[: len(docs) - k], codes[k:], 0)
        terms.append(term)
    order = np.lexsort((*terms[::-1], docs))
    terms, docs = [t[order] for t in terms], docs[order]
    first = _runs([docs, *terms])
    n = np.diff(np.append(first, len(docs)))
    terms, docs = [t[first] for t in terms], docs[first]
    known, same = np.zeros(len(docs), np.int64), np.concatenate([[False], docs[1:] == docs[:-1]])[: len(docs)]
    for t in terms:
        same[1:] &= (t[1:] == t[:-1]) & (t[1:] > 0)
        known += same
    order = np.lexsort((known, *terms[::-1]))
    terms, known, n = [t[order] for t in terms], known[order], n[order]
    first = _runs([*terms, known])
    return [t[first] for t in terms], known[first], np.add.reduceat(n, first), np.diff(np.append(first, len(n)))


def _packed(text: memoryview, numbers: np.ndarray) -> bytes:
    raw = pa.py_buffer(struct.pack("<qq", len(text), numbers.shape[1]) + bytes(text) + numbers.tobytes())
    return struct.pack("<q", raw.size) + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = pa.decompress(blob[8:], struct.unpack("<q", blob[:8])[0], "zstd", asbytes=True)
    size, rows = struct.unpack("<qq", raw[:16])
    text = np.frombuffer(raw, np.uint8, size, 16)
    ends = np.nonzero(text == 10)[0]
    joined = pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(np.concatenate([[0], ends + 1]).astype(np.int32)), pa.py_buffer(text)])
    return pc.utf8_slice_codeunits(joined, 0, -1), np.frombuffer(raw, np.int32, rows * 3, 16 + size).reshape(3, rows)


def _routed(records: list[list[str]], max_len: int, routes: int) -> pa.RecordBatch:
    """The suffixes of ``records`` as one packed, sorted block for each route."""
    import xxhash

    numbers: dict[str, int] = {}
    codes = np.fromiter((numbers.setdefault(w, len(numbers)) for r in records for w in r), np.int64)
    names, out = [], []
    if len(codes):
        vocabulary = sorted(numbers)
        rank = np.empty(len(vocabulary), np.int64)
        rank[[numbers[w] for w in vocabulary]] = np.arange(1, len(vocabulary) + 1)
        docs = np.repeat(np.arange(len(records)), [len(r) for r in records])
        terms, known, n, fresh = record_suffixes(rank[codes], docs, max_len)
        hashes = np.array([0, *(xxhash.xxh64_intdigest(w) for w in vocabulary)], np.uint64)
        salt = mix(hashes[terms[1]]) % np.uint64(ROUTES_PER_TERM) if max_len > 1 else np.uint64(0)
        route = (mix(hashes[terms[0]] + salt) % np.uint64(routes)).astype(np.int64)
        order = np.argsort(route, kind="stable")
        words = pa.array(["", *vocabulary])
        parts = [words.take(t[order]) for t in terms]
        parts[-1] = pc.binary_join_element_wise(parts[-1], "", "\n")
        joined = pc.binary_join_element_wise(*parts, BETWEEN) if max_len > 1 else parts[0]
        offsets = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1, joined.offset * 4)
        text = memoryview(joined.buffers()[2])
        told = np.stack([known, n, fresh]).astype(np.int32)[:, order]
        route = route[order]
        starts = _runs([route])
        for a, b in zip(starts, np.append(starts[1:], len(route))):
            names.append(int(route[a]))
            out.append(_packed(text[offsets[a] : offsets[b]], np.ascontiguousarray(told[:, a:b])))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(out, pa.binary())], ["route", "block"])


class PrefixStack:
    """Counts of all prefixes of suffixes that come in reverse order, batch after batch.

    What a batch leaves open, the path of its last suffix, stays on the stack: one entry for each length, with the
    occurrences and records so far.
    """

    def __init__(self, max_len: int, least: int):
        self.max_len, self.least = max_len, least
        self.path: list[str] = []
        self.counts = np.zeros((2, max_len), np.int64)

    def push(self, suffixes: pa.Array, known: np.ndarray, n: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
        """Prefixes that ended before the last suffix of the batch; a single term's routes are added up later, so it is always told."""
        rows, size = len(suffixes), self.max_len
        flat = pc.split_pattern(suffixes, BETWEEN).flatten() if size > 1 else suffixes
        terms = [flat.take(np.arange(k, rows * size, size)) for k in range(size)]
        before = self.path or [None] * size
        runs: list[pa.Array] = []
        numbers: list[np.ndarray] = []
        differs = np.zeros(rows, bool)
        path, open_ = [], np.zeros((2, size), np.int64)
        for k in range(size):
            differs[1:] |= pc.not_equal(terms[k].slice(1), terms[k].slice(0, rows - 1)).to_numpy(zero_copy_only=False)
            differs[0] |= terms[k][0].as_py() != before[k]
            start = np.nonzero(differs)[0]
            edge = np.concatenate([[0], start]) if not len(start) or start[0] else start  # an open prefix may go on
            sums = np.stack([np.add.reduceat(n, edge), np.add.reduceat(np.where(known <= k, fresh, 0), edge)])
            if not len(start) or start[0]:
                sums[:, 0] += self.counts[:, k]
            elif self.path and self.path[k]:
                runs.append(pa.array([BETWEEN.join(self.path[: k + 1])]))
                numbers.append(self.counts[:, k : k + 1])
            path.append(terms[k][rows - 1].as_py())
            open_[:, k] = sums[:, -1]
            done, sums = edge[:-1], sums[:, :-1]
            if k:
                kept = sums[1] >= self.least
                done, sums = done[kept], sums[:, kept]
            names = [terms[x].take(done) for x in range(k + 1)]
            filled = pc.not_equal(names[-1], "").to_numpy(zero_copy_only=False)
            runs.append((pc.binary_join_element_wise(*names, BETWEEN) if k else names[0]).filter(pa.array(filled)))
            numbers.append(sums[:, filled])
        self.path, self.counts = path, open_
        return self._told(runs, np.concatenate(numbers, axis=1))

    def end(self) -> pa.RecordBatch:
        """What is left on the stack."""
        kept = [k for k, w in enumerate(self.path) if w]
        return self._told([pa.array([BETWEEN.join(self.path[: k + 1]) for k in kept], pa.string())], self.counts[:, kept])

    @staticmethod
    def _told(runs: list[pa.Array], numbers: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays(runs), pa.array(numbers[0]), pa.array(numbers[1])], ["run", "occurrences", "records"])


def term_frequencies(df: DataFrame, text: str = "text", max_len: int = 1, min_records: int = 1) -> DataFrame:
    """Rows ``(terms, occurrences, records)`` for every run of 1 to ``max_len`` terms in at least ``min_records`` records; every row of ``df`` is a record.

    A suffix carries its count and in how many records it brings the record to the prefixes longer than ``known`` terms.
    These numbers add up, so no record sets travel. Null and empty texts hold no terms; further columns are ignored; an
    empty table gives no rows.
    """
    routes = ROUTES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        findall = regex.compile(TERM).findall
        held: list[list[str]] = []
        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.append(terms_of(findall, t))
                size += len(held[-1])
                if size > HELD:
                    yield _routed(held, max_len, routes)
                    held, size = [], 0
        yield _routed(held, max_len, routes)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                suffixes, numbers = _unpacked(blob)
                for a in range(0, len(suffixes), UNPACKED):
                    yield pa.RecordBatch.from_arrays([suffixes.slice(a, UNPACKED), *(pa.array(x[a : a + UNPACKED]) for x in numbers)], ["suffix", "known", "n", "fresh"])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = PrefixStack(max_len, min_records)
        for batch in batches:
            if batch.num_rows:
                yield prefixes.push(batch.column(0), *(c.to_numpy() for c in batch.columns[1:]))
        yield prefixes.end()

    if max_len < 1:
        raise ValueError("max_len must be at least 1")
    blocks = arrow_stage(pick(df, t=text).where("t is not null"), cut, "route int, block binary").repartition("route")
    suffixes = arrow_stage(blocks.select("block"), unpack, "suffix string, known int, n int, fresh int").sortWithinPartitions(F.col("suffix").desc())
    found = arrow_stage(suffixes, stack, "run string, occurrences long, records long")
    found = found.groupBy("run").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return found.where(F.col("records") >= min_records).select(F.split("run", BETWEEN).alias("terms"), "occurrences", "records")


def marked_terms(df: DataFrame, text: str = "text", rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE) -> DataFrame:
    """Rows ``(term, occurrences, records, mark)`` for every distinct term.

    ``mark``: ``rare`` in at most ``rare_records`` records, ``common`` in more than ``common_share`` of all rows of
    ``df`` (null texts included), else null; a term that would be both is ``rare``.
    """
    rows = df.count()
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(rows * common_share), "common")
    return term_frequencies(df, text).select(F.col("terms")[0].alias("term"), "occurrences", "records", mark.alias("mark"))
