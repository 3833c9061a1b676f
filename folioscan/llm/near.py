"""Near-duplicate records by signatures of hierarchical Poisson processes, bands, and verification; pairs and groups."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import MAX_TERM_BYTES, TERM, arrow_stage, pick
from folioscan.plans.shared import materialise

#: Values of a band, and the chance that a pair exactly at the similarity asked for shares none.
ROWS, MISS = 8, 5e-4
#: Values of a signature; once bands have used them all, further bands group them anew.
REGISTERS = 512
#: Weights are discretised to 1 to MAX_LEVEL units; the verification counts them whole.
MAX_LEVEL = 128
MIN_TERMS, SIMILARITY, GROUP_SIMILARITY = 20, 0.7, 0.8
#: Words of 64 parity bits of a bag.
WORDS = 4
#: Record counts of terms, by which the prefix filter orders them, are kept in a table of fixed size.
COUNT_BINS = 1 << 18
#: Records are marked in a table of so many slots, the most that is broadcast.
SLOTS = 1 << 20
#: Documents whose signatures are computed at once.
CHUNK = 400
#: Pairs of postings looked at together.
PAIRS = 1 << 20
#: Taken off before rounding up, so that no bound is a term too high.
EPS = 1e-9

_GOLDEN, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Waiting times of a Poisson process by the first 16 bits of a random number: the same on every machine.
_GAPS = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _processes(hashes: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Elements spread over the dyadic parts of the weight axis: (0, 1], (1, 2], (2, 4], (4, 8] ... units.

    Each part has a Poisson process of its own, fixed by element and part, so two bags share all points below the
    lesser of their weights.
    """
    source, seeds, width, low = [], [], [], []
    k, start, size = 0, 0, 1
    while start < MAX_LEVEL:
        at = np.nonzero(levels > start)[0]
        source.append(at)
        seeds.append(mix(hashes[at] + np.uint64((k + 1) * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF)))
        width.append(np.full(len(at), size, np.int64))
        low.append(np.full(len(at), start, np.int64))
        k, start, size = k + 1, start + size, max(1, start + size)
    return tuple(np.concatenate(x) for x in (source, seeds, width, low))


def bag_signatures(docs: np.ndarray, hashes: np.ndarray, levels: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """``n_docs`` x ``m`` signature values; equal values in a place occur with probability of the weighted Jaccard similarity.

    ``docs``, ``hashes``, ``levels``: for each element of each bag its bag, its 64-bit hash and its weight in units. The points of an
    element's process come in order of time, each in one of ``m`` registers and at one weight; points above the
    element's weight in the bag don't count. A register keeps its earliest point. The time up to which points are
    generated follows from the bag's whole weight; bags with registers still empty go on to twice that time.
    """
    sig = np.full(n_docs * m, np.inf, np.float32)
    source, seeds, width, low = _processes(hashes, levels)
    owner = docs[source]
    room = (levels[source] - low).astype(np.uint64)  # points at weights from here up don't count
    whole = np.bincount(docs, weights=levels, minlength=n_docs)
    until = np.where(whole > 0, m * (np.log(m) + 2) / np.maximum(whole, 1), 0.0)
    waiting = until > 0
    while waiting.any():
        at = np.nonzero(waiting[owner])[0]
        own, seed, wide, space = owner[at], seeds[at], width[at].astype(np.uint64), room[at]
        end = until[own] * width[at]  # processes run at one point a unit of time: the true time is this over the width
        now, step = np.zeros(len(at)), 0
        while len(own):
            step += 1
            r = mix(seed + np.uint64(step * int(_GOLDEN) & 0xFFFFFFFFFFFFFFFF))
            now = now + _GAPS[(r >> np.uint64(48)).astype(np.int64)]
            inside = now <= end
            hit = np.nonzero(inside & ((r & (wide - np.uint64(1))) < space))[0]  # widths are powers of two
            register = (r[hit] >> np.uint64(16) & np.uint64(0xFFFFFFFF)) % np.uint64(m)
            np.minimum.at(sig, own[hit] * m + register.astype(np.int64), (now[hit] / wide[hit]).astype(np.float32))
            kept = np.count_nonzero(inside)
            if kept < 0.75 * len(own):
                own, seed, wide, space, end, now = (x[inside] for x in (own, seed, wide, space, end, now))
        waiting &= np.isinf(sig.reshape(n_docs, m)).any(axis=1)
        until = np.where(waiting, until * 2, until)
    return sig.reshape(n_docs, m)


def band_count(similarity: float) -> int:
    """Bands with which a pair of this similarity shares none with a chance of ``MISS``."""
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(similarity, 0.999) ** ROWS)))


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    """``n_docs`` x ``bands`` 32-bit hashes, each of ``ROWS`` values of a signature.

    The first bands take the registers in order; each further round takes them in another order, in which no two
    registers that met before meet again.
    """
    n, m = sig.shape
    per = m // ROWS
    values = mix(sig.view(np.uint32).astype(np.uint64) + np.arange(m, dtype=np.uint64) * _GOLDEN)
    out = np.zeros((n, bands), np.uint64)
    for b in range(bands):
        turn, k = divmod(b, per)
        at = np.arange(ROWS)
        # the row's register: its own block in the first turn, then one of each eighth, shifted by the turn
        at = k * ROWS + at if not turn else at * per + (k + (turn - 1) * at) % per
        h = np.full(n, np.uint64(b), np.uint64)
        for r in at:
            h = mix(h + values[:, r])
        out[:, b] = h
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


class _Bags:
    """Bags of terms: their hashes, remembered per worker up to a bound, and how often they occur."""

    def __init__(self, counted: bool, min_terms: int):
        import regex
        import xxhash

        self.counted, self.least = counted, max(1, min_terms)
        self.findall, self.hash = regex.compile(TERM).findall, xxhash.xxh64_intdigest
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Sorted hashes of the distinct terms and their weights; none for a text of too few terms."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        found = Counter(self.findall(text)) if self.counted else dict.fromkeys(self.findall(text), 1)
        terms: dict[str, int] = {}
        for w, n in found.items():
            if len(w) < 10 or len(w.encode()) < MAX_TERM_BYTES:
                low = w.lower()
                terms[low] = terms.get(low, 0) + n if self.counted else 1
        if len(terms) < self.least:
            return None
        for w in terms:
            if w not in known:
                known[w] = self.hash(w)
        h = np.fromiter(map(known.__getitem__, terms), np.uint64, len(terms))
        order = np.argsort(h)
        return h[order], np.fromiter(terms.values(), np.int64, len(terms))[order]


def _elements(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number for every occurrence: bags have as many of them in common as occurrences."""
    flat = np.repeat(h, n)
    turn = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    return np.where(turn > 0, mix(flat + turn * _GOLDEN), flat)


def _parity(docs: np.ndarray, elements: np.ndarray, n_docs: int) -> pa.ListArray:
    """For each bag ``WORDS`` x 64 bits, each flipped by its elements: two bags differ in no more bits than elements."""
    bit = mix(elements) % np.uint64(WORDS * 64)
    out = np.zeros(n_docs * WORDS, np.uint64)
    np.bitwise_xor.at(out, docs * WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return pa.ListArray.from_arrays(pa.array(np.arange(n_docs + 1, dtype=np.int32) * WORDS), pa.array(out.view(np.int64)))


def _texts(df: DataFrame, row_id: str, text: str) -> DataFrame:
    return pick(df, i=row_id, t=text).where("i is not null and t is not null and t != ''")


def signature_table(docs: DataFrame, min_terms: int, bands: int, counted: bool) -> DataFrame:
    """``(row_id, k1, k2, n, bands, parity)`` of records with enough distinct terms, written once.

    ``k1``, ``k2``: a hash of the whole bag; ``n``: its elements; ``bands``: a hash per band; ``parity``: parity bits of the bag.
    """

    def chunk(ids: list[int], bags: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        import xxhash

        sizes = np.array([len(h) for h, _ in bags])
        sig = bag_signatures(np.repeat(np.arange(len(bags)), sizes), np.concatenate([h for h, _ in bags]), np.minimum(np.concatenate([n for _, n in bags]), MAX_LEVEL), len(bags), REGISTERS)
        elements = [_elements(h, n) for h, n in bags]
        whole = np.array([len(e) for e in elements])
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes() + n.tobytes()) for h, n in bags), np.int64)
        hashes = band_hashes(sig, bands)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                *(pa.array(keys[x::2].copy()) for x in (0, 1)),
                pa.array(whole.astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(bags) + 1, dtype=np.int32) * bands), pa.array(hashes.reshape(-1))),
                _parity(np.repeat(np.arange(len(bags)), whole), np.concatenate(elements), len(bags)),
            ],
            ["row_id", "k1", "k2", "n", "bands", "parity"],
        )

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag_of = _Bags(counted, min_terms)
        ids: list[int] = []
        bags: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bag = bag_of(t)
                if bag is not None:
                    ids.append(i)
                    bags.append(bag)
                if len(ids) >= CHUNK:
                    yield chunk(ids, bags)
                    ids, bags = [], []
        if ids:
            yield chunk(ids, bags)

    return materialise(arrow_stage(docs, stage, "row_id long, k1 long, k2 long, n int, bands array<int>, parity array<long>"))


def _needed(na: Column, nb: Column, similarity: float) -> Column:
    """Common elements that two bags of these sizes need."""
    return F.ceil(F.lit(similarity / (1 + similarity)) * (na + nb) - F.lit(EPS))


def _classes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members ``(row_id, class_id)`` of the classes of equal bags, and their representatives ``(id, n, bands, parity)``."""
    reps = table.groupBy("k1", "k2").agg(F.min("row_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
    named = table.groupBy("k1", "k2").agg(F.min("row_id").alias("class_id"))
    return table.select("row_id", "k1", "k2").join(named, ["k1", "k2"]).select("row_id", "class_id").distinct(), reps


def _verified(docs: DataFrame, table: DataFrame, pairs: DataFrame, similarity: float, min_terms: int, counted: bool) -> DataFrame:
    """``(a, b, similarity)`` of the pairs ``(a, b)`` that reach it.

    Parity bits rule out pairs that can't; of the rest the texts are read again, and theirs only, and whole bags compared.
    """
    bits = table.groupBy("row_id").agg(F.first("n").alias("n"), F.first("parity").alias("p"), F.count("*").alias("texts"))
    a, b = (bits.select(F.col("row_id").alias(x), *(F.col(c).alias(f"{c}{x}") for c in ("n", "p", "texts"))) for x in ("a", "b"))
    differ = sum((F.bit_count(F.col("pa")[x].bitwiseXOR(F.col("pb")[x])) for x in range(WORDS)), F.lit(0))
    room = F.col("na") + F.col("nb") - 2 * _needed(F.col("na"), F.col("nb"), similarity)
    several = (F.col("textsa") > 1) | (F.col("textsb") > 1)  # an id with several texts is held against all of them below
    close = materialise(pairs.join(a, "a").join(b, "b").where((differ <= room) | several).select("a", "b"))
    ends = close.select(F.explode(F.array("a", "b")).alias("i"))
    slot = F.pmod(F.xxhash64("i"), F.lit(SLOTS))
    some = F.broadcast(ends.select(slot.alias("slot")).distinct())  # SLOTS rows at most; it may let others through
    wanted = docs.withColumn("slot", slot).join(some, "slot", "left_semi").select("i", "t").join(ends.distinct(), "i", "left_semi")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag_of = _Bags(counted, min_terms)
        for batch in batches:
            ids, bags = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bag = bag_of(t)
                if bag is not None:
                    ids.append(i)
                    bags.append(_elements(*bag).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bags, pa.list_(pa.int64()))], ["i", "bag"])

    bags = arrow_stage(wanted, stage, "i long, bag array<long>")
    common = F.size(F.array_intersect("s", "t"))
    share = common / (F.size("s") + F.size("t") - common)
    found = close.join(bags.toDF("a", "s"), "a").join(bags.toDF("b", "t"), "b").select("a", "b", share.alias("similarity")).where(F.col("similarity") >= similarity)
    return found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _slots(reps: DataFrame) -> DataFrame:
    return reps.select("id", "n", F.explode("bands").alias("h"))


def _alike(x: str, y: str, similarity: float) -> Column:
    """Whether two sizes leave room for the similarity."""
    return F.least(x, y) >= F.lit(similarity) * F.greatest(x, y) - F.lit(EPS)


def near_duplicates(
    df: DataFrame, row_id: str = "row_id", text: str = "text", min_terms: int = MIN_TERMS, similarity: float = SIMILARITY, counted: bool = False, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Classes of records with one bag of terms, and the pairs of classes whose bags overlap.

    Returns ``(members, links)``: ``members`` is ``(row_id, class_id)`` for every record with at least ``min_terms`` distinct terms, the class named
    by its least ``row_id``; ``links`` is ``(class_a, class_b, similarity)`` with ``class_a < class_b``, where what the bags have in
    common is at least ``similarity`` of what they hold together. A bag holds each distinct term once, or ``counted`` as
    often as it occurs. Copies, however many, are one class, so no pairs arise among them. Candidates agree in at least one band
    of the signature; a pair exactly at ``similarity`` has a chance of ``MISS`` to agree in none, one above it a far lower one.
    ``exact`` adds the candidates of a prefix filter, which leaves out no pair and costs far more. Null, empty and short
    texts have no class; of an id with several texts each is held against the others' texts; further columns are ignored.
    """
    docs = _texts(df, row_id, text)
    table = signature_table(docs, min_terms, band_count(similarity), counted)
    members, reps = _classes(table)
    x, y = _slots(reps).toDF("a", "na", "h"), _slots(reps).toDF("b", "nb", "h")
    pairs = x.join(y, "h").where((F.col("a") < F.col("b")) & _alike("na", "nb", similarity)).select("a", "b").distinct()
    if exact:
        pairs = pairs.unionByName(prefix_pairs(docs, reps.select("id"), similarity, min_terms, counted)).distinct()
    links = _verified(docs, table, pairs, similarity, min_terms, counted)
    return members, links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity")


def components(links: DataFrame) -> DataFrame:
    """``(id, group)`` for every id in ``links`` ``(a, b)``: the least id that a chain of links leads to.

    Rounds of two steps: every id hands its least neighbour to the greater ones, then to the lesser ones, until each hangs
    on the least of its group alone. A round is joins and minima, so a hub of any degree is no task of its own.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    last = state(edges)
    while last.n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.toDF("u", "v")).distinct())
        now = state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group")).distinct())


def near_groups(
    df: DataFrame, row_id: str = "row_id", text: str = "text", min_terms: int = MIN_TERMS, similarity: float = GROUP_SIMILARITY, counted: bool = True, exact: bool = False
) -> DataFrame:
    """``(row_id, group_id, group_rows)``: records that a chain of pairs of at least ``similarity`` connects, the group named by its least ``row_id``.

    What a pair is, and ``exact``, are as in ``near_duplicates``; all records with enough terms come out, alone if nothing is
    like them. A family isn't paired within: first every record of a bucket is held against the bucket's least one and
    what is connected so far forms groups; then only records of different groups that share a bucket are compared.
    """
    docs = _texts(df, row_id, text)
    table = signature_table(docs, min_terms, band_count(similarity), counted)
    members, reps = _classes(table)
    slots = _slots(reps)
    first = slots.groupBy("h").agg(F.min_by("id", "id").alias("a"), F.min_by("n", "id").alias("na"), F.count("*").alias("size")).where("size > 1").drop("size")
    star = slots.join(first, "h").where((F.col("a") < F.col("id")) & _alike("na", "n", similarity)).select("a", F.col("id").alias("b")).distinct()
    linked = materialise(_verified(docs, table, star, similarity, min_terms, counted).select("a", "b"))
    so_far = components(linked)
    part = F.coalesce("group", "id").alias("part")
    placed = reps.join(so_far, "id", "left").select("id", "n", part, F.explode("bands").alias("h"))
    several = placed.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi").select("h")
    mixed = materialise(placed.join(several, "h"))
    main = mixed.groupBy("h", "part").agg(F.count("*").alias("size")).groupBy("h").agg(F.max_by("part", F.struct("size", "part")).alias("main"))
    mixed = mixed.join(main, "h")
    x, y = mixed.toDF("h", "a", "na", "part_a", "main"), mixed.where("part != main").drop("main").toDF("h", "b", "nb", "part_b")
    once = (F.col("part_a") == F.col("main")) | (F.col("a") < F.col("b"))
    across = x.join(y, "h").where((F.col("part_a") != F.col("part_b")) & once & _alike("na", "nb", similarity)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    if exact:
        across = across.unionByName(prefix_pairs(docs, reps.select("id"), similarity, min_terms, counted)).distinct()
    more = _verified(docs, table, across, similarity, min_terms, counted).select("a", "b")
    grouped = materialise(members.join(components(linked.unionByName(more)).withColumnRenamed("id", "class_id"), "class_id", "left").select("row_id", F.coalesce("group", "class_id").alias("group_id")).distinct())
    return grouped.join(grouped.groupBy("group_id").agg(F.count("*").alias("group_rows")), "group_id").select("row_id", "group_id", "group_rows")


def _record_counts(docs: DataFrame, min_terms: int) -> np.ndarray:
    """For each bin of term hashes its number of records."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag_of, bins = _Bags(False, min_terms), np.zeros(COUNT_BINS, np.int64)
        for batch in batches:
            bags = [b[0] for b in map(bag_of, batch.column(0).to_pylist()) if b is not None]
            if bags:
                bins += np.bincount((np.concatenate(bags) % np.uint64(COUNT_BINS)).astype(np.int64), minlength=COUNT_BINS)
        at = np.nonzero(bins)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(bins[at])], ["bin", "n"])

    got = arrow_stage(docs.select("t"), count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # COUNT_BINS rows at most
    out = np.zeros(COUNT_BINS, np.uint32)
    out[got["bin"].to_numpy(np.int64)] = np.minimum(got["n"].to_numpy(np.int64), 2**32 - 1)
    return out


def prefix_pairs(docs: DataFrame, reps: DataFrame, similarity: float, min_terms: int, counted: bool) -> DataFrame:
    """``(a, b)``, ids of ``reps``, ``a < b``, once: every pair whose bags reach ``similarity``, and some others.

    Such a pair has so many elements in common that the first of them, rarest first in one order for all, is among the first
    ``n - ceil(similarity n) + 1`` of the larger bag and among fewer of the smaller. Postings of these elements are sorted by
    size; a pair goes on if sizes, the places of the element and the parity bits leave room for enough common elements. All of
    these are bounds, none an estimate. Postings are held as far as sizes can match, one element at a time.
    """
    shared = similarity / (1 + similarity)
    counts = docs.sparkSession.sparkContext.broadcast(_record_counts(docs, min_terms))
    names = ["h", "n", "id", "p", *(f"w{x}" for x in range(WORDS))]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag_of = _Bags(counted, min_terms)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                bag = bag_of(t)
                if bag is None:
                    continue
                rarity = np.repeat(counts.value[(bag[0] % np.uint64(COUNT_BINS)).astype(np.int64)], bag[1])
                elements = _elements(*bag)
                n = len(elements)
                first = elements[np.lexsort((elements, rarity))][: n - math.ceil(similarity * n - EPS) + 1]
                bits = np.asarray(_parity(np.zeros(n, np.int64), elements, 1).values)
                for col, v in zip(out, (first.view(np.int64), *(np.full(len(first), v) for v in (n, i)), np.arange(len(first)), *(np.full(len(first), b) for b in bits))):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in out], names)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            old = len(held[0]) if held else 0
            cols = [np.concatenate(x) for x in zip(held, new)] if held else new
            h, n, key, p = cols[:4]
            bits = np.stack(cols[4:], axis=1).view(np.uint64)
            at = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) << 32  # element, then size: in order
            small = np.nonzero(p <= n - np.ceil(2 * shared * n - EPS))[0]
            lo = np.searchsorted((at + n)[small], at + np.ceil(similarity * n - EPS).astype(np.int64))
            count = np.maximum(np.searchsorted(small, np.arange(len(h))) - lo, 0)
            count[:old] = 0
            begin, whole = 0, np.cumsum(count)
            while begin < len(h):
                end = max(begin + 1, int(np.searchsorted(whole, (whole[begin - 1] if begin else 0) + PAIRS, "right")))
                c = count[begin:end]
                j = np.repeat(np.arange(begin, begin + len(c)), c)
                i = small[np.arange(len(j)) + np.repeat(lo[begin:end] - np.cumsum(c) + c, c)] if len(j) else j
                both = n[i] + n[j]
                need = np.ceil(shared * both - EPS).astype(np.int64)
                ok = (np.minimum(n[i] - p[i], n[j] - p[j]) >= need) & (key[i] != key[j])
                i, j, room = i[ok], j[ok], (both - 2 * need)[ok]
                ok = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= room
                x, y = key[i[ok]], key[j[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
                begin = end
            keep = (at == at[-1]) & (n >= np.ceil(similarity * n[-1] - EPS))
            held = [c[keep] for c in cols]

    wanted = docs.join(reps.select(F.col("id").alias("i")).distinct(), "i", "left_semi")
    postings = arrow_stage(wanted.select("i", "t"), post, ", ".join(f"{x} long" for x in names))
    return arrow_stage(postings.repartition("h").sortWithinPartitions("h", "n", "id"), stage, "a long, b long").distinct()


def linked_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(row_id, class_id, links)``: for each record its class and the number of other records similar to it."""
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    both = links.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other")).unionByName(links.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    near = both.join(sizes.toDF("other", "n"), "other").groupBy("class_id").agg(F.sum("n").alias("near"))
    per_class = sizes.join(near, "class_id", "left").select("class_id", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    return members.join(per_class, "class_id").select("row_id", "class_id", "links")


def linked_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """``(row_id_a, row_id_b)`` for all pairs of records, copies spelled out: only where a result in this form is asked for."""
    a, b = members.toDF("x", "class_a"), members.toDF("y", "class_b")
    across = links.join(a, "class_a").join(b, "class_b").select("x", "y")
    within = members.toDF("x", "class_id").join(members.toDF("y", "class_id"), "class_id").where("x < y").select("x", "y")
    return across.unionByName(within).where("x != y").select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()
