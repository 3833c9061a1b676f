"""Long stretches that stand word for word in several records, by a compacted graph of token k-mers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_stage, pick
from folioscan.llm.near import _GOLDEN, mix
from folioscan.plans.shared import materialise

MIN_CHARS = 200
#: Tokens of an edge of the graph.
K = 2
#: Classes are marked in a table of so many slots, the most that is broadcast.
SLOTS = 1 << 20
_POSITION_BITS = 24
#: Steps in which a run may lie about a path: runs that agree in one of so many stretches, all but a step long, are compared.
STEPS = 8
#: Characters worked on at once; a longer text is worked on alone.
CHUNK_CHARS = 1 << 19


def window_sizes(min_chars: int) -> tuple[int, int]:
    """Gram length g and window w, with which any run of ``min_chars`` holds at least K + 1 boundaries; w is under 2 g."""
    g = max(1, min_chars // 5)
    return g, max(1, (min_chars - g + 1) // (K + 1))


def _grams(codes: np.ndarray, g: int) -> np.ndarray:
    """Hashes of all runs of ``g`` characters, by doubling."""
    base = 0x100000001B3
    h, n = mix(codes.astype(np.uint64) + _GOLDEN), 1
    out, done, left = None, 0, g
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                # append this block behind what there is
                if out is None:
                    out = h
                else:
                    k = len(codes) - (done + n) + 1
                    out = out[:k] * np.uint64(pow(base, n, 1 << 64)) + h[done : done + k]
                done += n
            left >>= 1
            if left:
                k = len(h) - n
                h = h[:k] * np.uint64(pow(base, n, 1 << 64)) + h[n : n + k]
                n *= 2
    return mix(out)


def text_boundaries(codes: np.ndarray, first: np.ndarray, g: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Token boundaries of the texts that ``codes`` holds one after another, and the hashes of all grams.

    ``first``: where each text begins, and the end. A place is a boundary if its gram has the least hash, the last
    of equal ones, in some window of ``w`` grams that lies whole within its text: this depends on nothing but
    the ``w + g - 1`` characters of the window.
    """
    n = len(codes)
    windows = n - g - w + 2
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams = _grams(codes, g)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    at = np.arange(len(grams), dtype=np.uint64)
    least = (grams & ~low) | (low - (at & low))
    size = 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < w:
        least = np.minimum(least[: windows], least[w - size : w - size + windows])
    start = np.arange(windows)
    text = np.searchsorted(first, start, side="right") - 1
    whole = start + (w + g - 1) <= first[text + 1]
    place = (low - (least & low)).astype(np.int64)
    place += (start - place + (1 << _POSITION_BITS) - 1 >> _POSITION_BITS) << _POSITION_BITS
    place = np.unique(place[whole])
    return place, grams


def _edge_rows(texts: list[str], classes: list[int], g: int, w: int) -> tuple[np.ndarray, ...]:
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    place, grams = text_boundaries(codes, first, g, w)
    if len(place) <= K:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    text = np.searchsorted(first, place, side="right") - 1
    n = len(place) - K
    # a token by its first gram, the gram that ends with it, and its length: no two grams leave a gap, as tokens are under 2 g
    size = np.diff(place)
    token = mix(mix(grams[place[:-1]] + size.astype(np.uint64) * _GOLDEN) + grams[place[:-1] + np.maximum(0, size - g)])
    h = grams[place[K:]].copy()
    for k in range(K):
        h = mix(h * np.uint64(31) + token[k : k + n])
    same = text[:n] == text[K:]
    seq = np.arange(len(place)) - np.searchsorted(text, text, side="left")
    inside = place - first[text]
    own = np.array(classes, np.int64)[text[:n]]
    return h.view(np.int64)[same], own[same], seq[:n][same], inside[:n][same], inside[K:][same] + g


def text_edges(docs: DataFrame, min_chars: int) -> DataFrame:
    """``(h, cls, seq, lo, hi)``: the k-mers of tokens of every text, in order, with their places."""
    g, w = window_sizes(min_chars)
    names = ["h", "cls", "seq", "lo", "hi"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(texts: list[str], classes: list[int]) -> pa.RecordBatch:
            h, own, seq, lo, hi = _edge_rows(texts, classes, g, w)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(own), *(pa.array(x.astype(np.int32)) for x in (seq, lo, hi))], names)

        for batch in batches:
            texts: list[str] = []
            classes: list[int] = []
            held = 0
            for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held + len(t) > CHUNK_CHARS:
                    yield out(texts, classes)
                    texts, classes, held = [], [], 0
                texts.append(t)
                classes.append(c)
                held += len(t)
            if texts:
                yield out(texts, classes)

    return arrow_stage(docs.select("cls", "t"), stage, "h long, cls long, seq int, lo int, hi int")


def compacted_paths(edges: DataFrame) -> DataFrame:
    """Occurrences ``(path, cls, lo, hi)`` of the paths that edges of several texts form without branching.

    An edge is kept if two texts hold it. Two edges are linked if wherever the one stands the other follows, and
    nothing else comes before the other. A run of linked edges in a text is an occurrence of one path, named by its
    first edge.
    """
    shared = edges.groupBy("h").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a != b").select("h")
    kept = edges.join(shared, "h").groupBy("cls", "seq").agg(F.first("h").alias("h"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    order = Window.partitionBy("cls").orderBy("seq")
    follows = F.lead("seq").over(order) == F.col("seq") + 1
    comes = F.lag("seq").over(order) == F.col("seq") - 1
    placed = materialise(kept.withColumn("after", F.when(follows, F.lead("h").over(order))).withColumn("before", F.when(comes, F.lag("h").over(order))))
    after = placed.groupBy("h").agg(F.min("after").alias("n"), F.max("after").alias("n2"), F.count("after").alias("c"), F.count("*").alias("all")).where("n = n2 and c = all").select("h", "n")
    before = placed.groupBy("h").agg(F.min("before").alias("p"), F.max("before").alias("p2"), F.count("before").alias("c"), F.count("*").alias("all")).where("p = p2 and c = all").select(F.col("h").alias("n"), "p")
    # an edge that goes on from its only predecessor: `n` is the later edge of a link
    linked = after.join(before, "n").where("p = h").select(F.col("n").alias("h"), F.lit(True).alias("goes_on"))
    marked = placed.join(linked, "h", "left")
    begins = ~(F.coalesce("goes_on", F.lit(False)) & F.coalesce(F.lag("seq").over(order) == F.col("seq") - 1, F.lit(False)))
    runs = marked.withColumn("begin", F.when(begins, F.col("seq"))).withColumn("head", F.last("begin", True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("cls", "head").agg(F.min_by("h", "seq").alias("path"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("path", "cls", "lo", "hi")


def _extent(a: str, at_a: int, b: str, at_b: int, size: int) -> tuple[int, int]:
    """How many characters before and after the common core of ``size`` characters agree; -1 if the core differs."""
    if a[at_a : at_a + size] != b[at_b : at_b + size]:
        return -1, -1
    import os.path

    right = len(os.path.commonprefix((a[at_a + size :], b[at_b + size :])))
    left = len(os.path.commonprefix((a[:at_a][::-1], b[:at_b][::-1])))
    return left, right


def _shared_paths(df: DataFrame, row_id: str, text: str, min_chars: int) -> tuple[DataFrame, ...]:
    """Texts long enough, the members of their classes, the paths that classes share, and the texts of the classes on them."""
    docs = pick(df, row_id=row_id, t=text).where(F.char_length("t") >= min_chars).withColumn("cls", F.xxhash64("t"))
    members = docs.select("row_id", "cls", F.xxhash64(F.lit(1), "t").alias("again")).distinct()
    edges = materialise(text_edges(docs, min_chars))
    paths = materialise(compacted_paths(edges))
    # texts of the classes on paths only: the broadcast has SLOTS rows at most and may let others through
    slots = F.broadcast(paths.select(F.pmod("cls", F.lit(SLOTS)).alias("slot")).distinct())
    some = docs.select("cls", "t", F.pmod("cls", F.lit(SLOTS)).alias("slot")).join(slots, "slot", "left_semi").groupBy("cls").agg(F.first("t").alias("t"))
    return docs, members, paths, some


def shared_spans(df: DataFrame, row_id: str = "row_id", text: str = "text", min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts, and the long common runs between classes.

    Returns ``(members, spans)``: ``members`` is ``(row_id, cls, again)`` for each text of at least ``min_chars`` characters,
    two 64-bit hashes of the text that name its class; ``spans`` is ``(cls_a, cls_b, lo_a, hi_a, lo_b, hi_b)`` with ``cls_a < cls_b``, runs of
    at least ``min_chars`` equal characters, checked on the texts. A run is told for every shared path in it, with as much
    beside the path as makes ``min_chars``. Occurrences of a path with the same surroundings are one variant. A run of ``min_chars``
    about a path lies with one of ``STEPS`` parts of what it needs beside the path on the left and all but one of the rest on the right, so
    only variants with one such stretch in common are compared: a formula that many texts hold, but that is too short, makes no pairs.
    Null and short texts take no part; further columns are ignored; empty tables give no rows.
    """
    docs, members, paths, some = _shared_paths(df, row_id, text, min_chars)
    beside = F.greatest(F.lit(0), F.lit(min_chars) - (F.col("hi") - F.col("lo")))
    start = F.greatest(F.lit(0), F.col("lo") - beside)
    around = paths.join(some, "cls").select("path", "cls", "lo", (F.col("lo") - start).alias("before"), (F.col("hi") - F.col("lo")).alias("size"), F.substring("t", start + 1, F.col("hi") + beside - start).alias("t"))
    keys = ["path", "size", "before", "k1", "k2"]
    placed = around.withColumn("k1", F.xxhash64("t")).withColumn("k2", F.xxhash64(F.lit(1), "t"))
    placed = materialise(placed)
    variants = materialise(placed.groupBy(*keys).agg(F.first("t").alias("t")).withColumn("v", F.monotonically_increasing_id()))
    occurrences = materialise(placed.drop("t").join(variants.drop("t"), keys).select("v", "cls", "lo"))
    need = F.greatest(F.lit(0), F.lit(min_chars) - F.col("size"))

    def stretch(i: Column) -> Column:
        left = F.floor(i * need / STEPS).cast("int")
        right = F.greatest(F.lit(0), need - F.ceil((i + 1) * need / STEPS)).cast("int")
        whole = F.substring("t", F.col("before") - left + 1, left + F.col("size") + right)
        fits = (F.col("before") >= left) & (F.char_length("t") - F.col("before") - F.col("size") >= right)
        return F.when(fits, F.struct(i.alias("i"), F.xxhash64(whole).alias("g1"), F.xxhash64(F.lit(1), whole).alias("g2")))

    steps = F.sequence(F.lit(0), F.when(need > 0, F.lit(STEPS)).otherwise(F.lit(0)))
    by_stretch = variants.select("v", "path", "size", F.explode(F.array_compact(F.transform(steps, stretch))).alias("g")).select("v", "path", "size", "g.*")
    same = ["path", "size", "i", "g1", "g2"]
    pairs = by_stretch.withColumnRenamed("v", "v_a").join(by_stretch.withColumnRenamed("v", "v_b"), same).where("v_a < v_b").select("v_a", "v_b").distinct()
    sides = {x: variants.select(*(F.col(c).alias(f"{c}_{x}") for c in ("v", "size", "before", "t"))) for x in ("a", "b")}
    held = pairs.join(sides["a"], "v_a").join(sides["b"], "v_b").select("v_a", "v_b", F.least("size_a", "size_b").alias("size"), "before_a", "before_b", "t_a", "t_b")
    names = ["v_a", "v_b", "back", "length"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for va, vb, size, ba, bb, ta, tb in zip(*(c.to_pylist() for c in batch.columns)):
                before, after = _extent(ta, ba, tb, bb, size)
                if before >= 0 and before + size + after >= min_chars:
                    for col, v in zip(out, (va, vb, before, before + size + after)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    alike = arrow_stage(held, verify, ", ".join(f"{n} long" for n in names))
    within = variants.where(F.char_length("t") >= min_chars).select(F.col("v").alias("v_a"), F.col("v").alias("v_b"), F.col("before").cast("long").alias("back"), F.char_length("t").cast("long").alias("length"))
    both = alike.unionByName(within)
    for x in ("a", "b"):
        both = both.join(occurrences.toDF(f"v_{x}", f"cls_{x}", f"lo_{x}"), f"v_{x}")
    from_, to = (lambda x: F.col(f"lo_{x}") - F.col("back")), (lambda x: F.col(f"lo_{x}") - F.col("back") + F.col("length"))
    ordered = F.col("cls_a") < F.col("cls_b")
    span = lambda x, y: F.struct(F.col(f"cls_{x}").alias("cls_a"), F.col(f"cls_{y}").alias("cls_b"), from_(x).alias("lo_a"), to(x).alias("hi_a"), from_(y).alias("lo_b"), to(y).alias("hi_b"))
    once = (F.col("v_a") != F.col("v_b")) | ordered  # within a variant each pair comes both ways round
    spans = both.where((F.col("cls_a") != F.col("cls_b")) & once).select(F.when(ordered, span("a", "b")).otherwise(span("b", "a")).alias("s")).select("s.*")
    return members, spans


def shared_pairs(members: DataFrame, spans: DataFrame) -> DataFrame:
    """``(row_id_a, row_id_b)`` for all pairs of records, copies spelled out: only where a result in this form is asked for."""
    links = spans.select("cls_a", "cls_b").distinct()
    rows = members.select("row_id", "cls")
    across = links.join(rows.toDF("x", "cls_a"), "cls_a").join(rows.toDF("y", "cls_b"), "cls_b").select("x", "y")
    within = members.toDF("x", "cls", "again").join(members.toDF("y", "cls", "again"), ["cls", "again"]).where("x < y").select("x", "y")
    return across.unionByName(within).where("x != y").select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).distinct()


def repeated_spans(df: DataFrame, row_id: str = "row_id", text: str = "text", min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """``members`` as of ``shared_spans``, and ``(cls, lo, hi)``: the stretches of each class's text that also stand in another class.

    A stretch is the union of all windows of ``min_chars`` characters that two classes hold. Only windows around a
    shared path can be such; their hashes are counted, so the cost follows the texts and not the pairs: a passage in
    a third of all texts is as cheap as any.
    """
    docs, members, paths, some = _shared_paths(df, row_id, text, min_chars)
    regions = paths.groupBy("cls").agg(F.collect_list(F.struct("lo", "hi")).alias("paths")).join(some, "cls").select("cls", "t", "paths")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, t, found in zip(*(x.to_pylist() for x in batch.columns)):
                n = len(t) - min_chars + 1
                marks = np.zeros(n + 1, np.int64)
                for p in found:  # windows that hold the path's first edge begin between hi - min_chars and lo, and so on to its last
                    marks[max(0, p["lo"] - min_chars)] += 1
                    marks[min(n, p["hi"])] -= 1
                at = np.nonzero(np.cumsum(marks)[:n] > 0)[0]
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
                h = _grams(codes, min_chars)[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(at), c)), pa.array(at.astype(np.int32))], ["h", "cls", "place"])

    held = materialise(arrow_stage(regions, windows, "h long, cls long, place int"))
    both = held.groupBy("h").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a != b").select("h")
    order = Window.partitionBy("cls").orderBy("place")
    begins = F.when(F.coalesce(F.col("place") - F.lag("place").over(order) > min_chars, F.lit(True)), 1).otherwise(0)
    runs = held.join(both, "h").withColumn("begin", begins).withColumn("run", F.sum("begin").over(order))
    return members, runs.groupBy("cls", "run").agg(F.min("place").alias("lo"), (F.max("place") + min_chars).alias("hi")).drop("run")


def shared_shares(df: DataFrame, members: DataFrame, stretches: DataFrame, row_id: str = "row_id", text: str = "text", reference: str = "reference") -> DataFrame:
    """``(row_id, reference, chars, shared_chars, share, copies)`` for every record with a text: how much of it also stands elsewhere.

    ``stretches``: those of ``repeated_spans``, which don't overlap. ``copies``: other records with the same text, all of whose characters
    count as shared. Empty texts have the share 0.
    """
    covered = stretches.groupBy("cls").agg(F.sum(F.col("hi") - F.col("lo")).alias("covered"))
    sizes = members.groupBy("cls", "again").agg((F.count("*") - 1).alias("copies"))
    rows = pick(df, row_id=row_id, reference=reference, t=text).where("t is not null").select("row_id", "reference", F.xxhash64("t").alias("cls"), F.xxhash64(F.lit(1), "t").alias("again"), F.char_length("t").cast("long").alias("chars"))
    copies = F.coalesce("copies", F.lit(0))
    shared = F.when(copies > 0, F.col("chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return (
        rows.join(sizes, ["cls", "again"], "left")
        .join(covered, "cls", "left")
        .select("row_id", "reference", "chars", shared.alias("shared_chars"), F.round(F.coalesce(shared / F.nullif(F.col("chars"), F.lit(0)), F.lit(0.0)), 6).alias("share"), copies.alias("copies"))
    )
