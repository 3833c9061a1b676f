"""Repair of text from scanned pages: layout marks, broken words, misrecognised characters."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import TERM, arrow_stage, pick, terms_of
from folioscan.plans.shared import materialise

# What a character or pair is misrecognised as. Left the true form, right the read ones.
CONFUSIONS = {
    "a": "o", "b": "h", "c": "e", "d": "cl", "e": "c", "f": "t", "g": "9", "h": "b", "i": "! l 1", "l": "1 i", "m": "rn",
    "n": "ri", "o": "0 a", "s": "5", "t": "f", "u": "ii", "w": "vv", "cl": "d", "ii": "u", "li": "h", "ri": "n", "rn": "m", "vv": "w",
    "ב": "כ", "ג": "נ", "ד": "ר", "ה": "ח", "ו": "1 | ז י ן", "ז": "ו", "ח": "ה ת", "ט": "מ", "י": "ו", "כ": "ב",
    "ם": "ס מ", "מ": "ט ם", "ן": "ו נ", "נ": "ן ג", "ס": "ם 0", "ע": "צ", "צ": "ע", "ר": "ד", "ת": "ח",
}
#: Probability of a confusion before it is estimated, the most it may come to, and the weight of the first guess in occurrences.
ERROR, MOST_ERROR, PRIOR = 0.002, 0.05, 200.0
#: Rounds in which the probabilities are estimated.
ROUNDS = 3
#: Log probability below which a spelling is one that no word has.
ODD_SPELLING = -45.0
#: Weight of a pair of neighbouring words against the words themselves, the most its logarithm may be, and what is added to its counts.
CONTEXT, MOST_CONTEXT, PAIR_PRIOR = 0.3, 3.0, 1.0
#: Bins of character trigrams: a table of fixed size.
TRIGRAMS = 1 << 18
#: Slots of the tables that mark words and pairs, the most that is broadcast.
SLOTS = 1 << 22
HYPHENS = "-־¬="
WORD = r"[\p{L}\p{M}\p{N}|!]*[\p{L}\p{M}\p{N}|]"
# Forms of a page number that stands alone.
PAGE = r"\s*(?:\d+|\[\s*\d+\s*\]|\(\s*\d+\s*\)|[-–—]\s*\d+\s*[-–—]|\d+\s*/\s*\d+|(?:p|pp|page|עמוד|עמ['׳]|דף)\.?\s*(?:\d+|[א-ת]{1,4}['\"׳״]?[א-ת]?)|[ivxlc]+|[IVXLC]+)\s*"
# What stands beside a title in a running header.
BESIDE = r"(?:\b(?:ch|chapter|p|page)\b\.?\s*\d+)|(?:(?:פרק|דף|עמוד)\s+[א-ת\d]{1,4}(?![א-ת]))|\d+|[|\[\]()—–]"

#: Confusions ``(true, read)`` by number, and for what is read the numbers of what it may be.
PAIRS = [(true, seen) for true, read in CONFUSIONS.items() for seen in read.split()]
_READ: dict[str, list[int]] = defaultdict(list)
for _k, (_, _seen) in enumerate(PAIRS):
    _READ[_seen].append(_k)
_READ = dict(_READ)
_NOISE = set("0123456789|!")
#: Signs that no word has and the letters that they are read for, as one sign of each group: words with one key may be readings of each other.
_KEY_OF = str.maketrans({c: sign for sign, letters in (("1", "!|ilו"), ("0", "oס"), ("5", "s"), ("9", "g")) for c in letters})
_POINTS = dict.fromkeys([*range(0x591, 0x5BE), 0x5BF, 0x5C1, 0x5C2, 0x5C4, 0x5C5, 0x5C7])
COMPOUND = r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}]+[-־][\p{L}\p{M}]+(?![\p{L}\p{M}\p{N}])"


def bare(word: str) -> str:
    """``word`` without vowel points and accents: their few counts tell nothing of its letters."""
    return word if word.isalnum() else word.translate(_POINTS)


def undone(word: str, since: int = 0) -> Iterator[tuple[str, int, int]]:
    """Words with one confusion of ``word`` undone, at ``since`` or later: the word, the confusion, and where the rest begins."""
    for i in range(since, len(word)):
        for k in (1, 2):
            for c in _READ.get(word[i : i + k], ()) if i + k <= len(word) else ():
                true = PAIRS[c][0]
                yield word[:i] + true + word[i + k :], c, i + len(true)


def candidates(word: str, two: bool = True) -> dict[str, tuple[int, ...]]:
    """Words that ``word`` may be a misreading of by one confusion, or two, each with its confusions."""
    out: dict[str, tuple[int, ...]] = {}
    for form, c, rest in undone(word):
        out.setdefault(form, (c,))
        if two:
            for other, d, _ in undone(form, rest):
                if len(out.get(other, (0, 0))) > 1:
                    out[other] = (c, d)
    out.pop(word, None)
    return out


def signs_undone(word: str, form: str) -> tuple[int, ...] | None:
    """The confusions that make ``form`` of ``word`` if all its signs that no word has are replaced and nothing else is."""
    out = []
    if len(word) != len(form):
        return None
    for read, true in zip(word, form):
        if read in _NOISE:
            c = next((c for c in _READ.get(read, ()) if PAIRS[c][0] == true), None)
            if c is None:
                return None
            out.append(c)
        elif read != true:
            return None
    return tuple(out)


class Page:
    """The lines of a text and what each is."""

    def __init__(self) -> None:
        import regex

        self.page, self.beside = regex.compile(PAGE), regex.compile(BESIDE, regex.I)
        self.word = regex.compile(WORD)

    def _title_like(self, line: str, title: str) -> bool:
        core = " ".join(self.beside.sub(" ", line).lower().split())
        for form in (core, " ".join(line.lower().split())):
            if abs(len(form) - len(title)) <= 3 and len(title) > 3:
                if form == title:
                    return True
                common = sum((Counter(form) & Counter(title)).values())
                if common >= 0.75 * len(title) and _distance(form, title) <= max(1, len(title) // 5):
                    return True
        return False

    def kinds(self, text: str, titles: list[str | None]) -> tuple[list[str], list[str]]:
        """Lines, and for each ``pageno``, ``header``, ``blank`` or ``text``. A text of one line has neither header nor number."""
        lines = text.split("\n")
        known = {" ".join(t.lower().split()) for t in titles if t and t.strip()}
        limit = max(map(len, known), default=0) + 20
        kinds = []
        filled = sum(1 for x in lines if x.strip())
        for line in lines:
            if not line.strip():
                kinds.append("blank")
            elif filled > 1 and len(line) < 24 and self.page.fullmatch(line):
                kinds.append("pageno")
            elif filled > 1 and len(line) <= limit and any(self._title_like(line, t) for t in known):
                kinds.append("header")
            else:
                kinds.append("text")
        if "text" not in kinds:
            kinds = ["blank" if k == "blank" else "text" for k in kinds]
        return lines, kinds

    def breaks(self, lines: list[str], kinds: list[str]) -> dict[int, int]:
        """Running lines that end in half a word, each with the line where the word goes on."""
        running = [k for k, kind in enumerate(kinds) if kind == "text"]
        out = {}
        for k, after in zip(running, running[1:]):
            end, start = lines[k].rstrip(), lines[after].lstrip()
            if len(end) > 1 and end[-1] in HYPHENS and self.word.match(end[-2]) and self.word.match(start):
                out[k] = after
        return out

    def distinct(self, lines: list[str], kinds: list[str]) -> tuple[set[str], set[tuple[str, str]]]:
        """All words of the running lines, lower-cased and without points, broken ones joined, and the broken ones with
        what they are if the hyphen is their own."""
        breaks = self.breaks(lines, kinds)
        out: set[str] = set()
        broken: set[tuple[str, str]] = set()
        half = sign = ""
        for k, (line, kind) in enumerate(zip(lines, kinds)):
            if kind != "text":
                continue
            found = self.word.findall(line.lower())
            if half:
                broken.add((bare(half + found[0]), bare(half) + sign + bare(found[0])))
                found[0] = half + found[0]
                half = ""
            if k in breaks:
                half, sign = found.pop(), line.rstrip()[-1]
            out.update(map(bare, found))
        return {w for w in out if not w.isdecimal() and _is_word(w)}, broken

    def line(self, lines: list[str], k: int, breaks: dict[int, int]) -> list[tuple[str, list[tuple[int, int, int]]]]:
        """The words of a running line with their places ``(line, start, end)``. A broken word belongs to the line where it
        begins and has two places; the line where it goes on doesn't tell it again."""
        found = [(m.group(), [(k, *m.span())]) for m in self.word.finditer(lines[k])]
        if k in breaks.values():
            del found[0]
        if k in breaks and found:
            after = breaks[k]
            m = self.word.search(lines[after])
            word, places = found[-1]
            found[-1] = (word + m.group(), [*places, (after, *m.span())])
        return found


def _distance(a: str, b: str) -> int:
    """Edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _is_word(w: str) -> bool:
    return any(c.isalpha() for c in w)


def _trigrams(word: str) -> list[int]:
    import xxhash

    padded = f"^^{word}$"
    return [xxhash.xxh32_intdigest(padded[i : i + 3]) % TRIGRAMS for i in range(len(padded) - 2)]


class LanguageModel:
    """Word and character n-gram probabilities. Its tables have a fixed size; word and pair counts come by joins."""

    def __init__(self, tokens: int, once: int, triples: np.ndarray, pairs: np.ndarray):
        self.tokens, self.once, self.new = max(tokens, 1), once, (once + 1) / (tokens + 2)
        self.triples, self.pairs = triples, pairs

    def step(self, before: str, sign: str) -> float:
        """Log probability of ``sign`` after two others."""
        import xxhash

        triple, pair = xxhash.xxh32_intdigest(before + sign) % TRIGRAMS, xxhash.xxh32_intdigest(before) % TRIGRAMS
        return math.log((self.triples[triple] + 0.01) / (self.pairs[pair] + 1.0))

    def spelling(self, word: str) -> float:
        """Log probability of ``word`` as one that the corpus doesn't hold."""
        padded = f"^^{word}$"
        return math.log(self.new) + sum(self.step(padded[i : i + 2], padded[i + 2]) for i in range(len(padded) - 2))

    def score(self, word: str, count: int) -> float:
        return math.log(count / self.tokens) if count else self.spelling(word)


def _corpus_counts(clean: DataFrame) -> DataFrame:
    """``(kind, key, n)``: words (``w``) and compounds with a hyphen of their own (``c``) of the clean texts, without points."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        findall, compounds = regex.compile(TERM).findall, regex.compile(COMPOUND).findall
        counts: dict[str, Counter[str]] = {"w": Counter(), "c": Counter()}

        def out() -> Iterator[pa.RecordBatch]:
            for kind, held in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(held), pa.string()), pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["kind", "key", "n"])
                held.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts["w"].update(map(bare, terms_of(findall, t)))
                if "-" in t or "־" in t:
                    counts["c"].update(bare(w.lower()) for w in compounds(t))
            if len(counts["w"]) + len(counts["c"]) > 300_000:
                yield from out()
        yield from out()

    return arrow_stage(clean, stage, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _model(counts: DataFrame) -> LanguageModel:
    vocabulary = counts.where("kind = 'w'")
    total = vocabulary.agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).first()

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        three, two = np.zeros(TRIGRAMS), np.zeros(TRIGRAMS)
        for batch in batches:
            for w in batch.column(0).to_pylist():
                padded = f"^^{w}$"
                for i, t in enumerate(_trigrams(w)):
                    three[t] += 1
                    two[xxhash.xxh32_intdigest(padded[i : i + 2]) % TRIGRAMS] += 1
        for kind, table in ((3, three), (2, two)):
            at = np.nonzero(table)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind)), pa.array(at), pa.array(table[at])], ["kind", "bin", "n"])

    grams = arrow_stage(vocabulary.select("key"), stage, "kind long, bin long, n double").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()  # 2 * TRIGRAMS rows at most
    tables = {k: np.zeros(TRIGRAMS) for k in (2, 3)}
    for k, table in tables.items():
        part = grams[grams["kind"] == k]
        table[part["bin"].to_numpy(np.int64)] = part["n"].to_numpy()
    return LanguageModel(total.n or 0, total.once or 0, tables[3], tables[2])


def _marked(keys: DataFrame) -> np.ndarray:
    """A table of ``SLOTS`` bits with those of ``keys`` set, by the sum of their bytes; it has one size for any number of keys."""
    slot = f"pmod(crc32(`{keys.columns[0]}`), {SLOTS})"
    words = keys.selectExpr(f"{slot} div 64 as at", f"shiftleft(1L, cast({slot} % 64 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # SLOTS / 64 rows at most
    out = np.zeros(SLOTS // 64, np.int64)
    out[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _best_signs(word: str, lm: LanguageModel, chance: np.ndarray) -> tuple[str, tuple[int, ...]] | None:
    """The likeliest word by its spelling, of all that ``word`` is with its signs replaced: Viterbi over its characters."""
    states: dict[str, tuple[float, str, tuple[int, ...]]] = {"^^": (0.0, "", ())}
    for read in [*word, "$"]:
        options = [(PAIRS[c][0], (c,)) for c in _READ.get(read, ()) if len(PAIRS[c][0]) == 1] if read in _NOISE else [(read, ())]
        new: dict[str, tuple[float, str, tuple[int, ...]]] = {}
        for last, (total, form, used) in states.items():
            for true, c in options:
                here = total + lm.step(last, true) + sum(chance[x] for x in c)
                key = last[1] + true
                if key not in new or new[key][0] < here:
                    new[key] = here, form + true, used + c
        states = new
    if not states:
        return None
    _, form, used = max(states.values())
    return form[:-1], used


def _proposals(types: DataFrame, counts: DataFrame, model: LanguageModel) -> DataFrame:
    """``(word, m, own, forms)``: words of scanned texts with ``m`` records and ``own`` occurrences in clean texts, and what they may
    be a misreading of: forms with their occurrences and confusions, written once.

    Every form by one confusion that the corpus holds, and by two for a word that it doesn't. Words with signs that no word has
    meet all words with the same key, and get the form of the likeliest spelling; one that the corpus doesn't hold stands only for
    these, and for spellings that no word has.
    """
    spark = types.sparkSession
    words = counts.where("kind = 'w'").select("key", "n")
    known = spark.sparkContext.broadcast(np.packbits(_marked(words.select("key"))))
    shared = spark.sparkContext.broadcast((model.tokens, model.once, model.triples, model.pairs))
    tokens, most = model.tokens, MOST_ERROR * math.exp(4 * CONTEXT * MOST_CONTEXT)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        lm, bits, chance = LanguageModel(*shared.value), np.unpackbits(known.value).astype(bool), np.full(len(PAIRS), math.log(ERROR))
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for w, m, n in zip(*(c.to_pylist() for c in batch.columns)):
                if n / tokens > most:  # no candidate's share can be over 1
                    continue
                signs = [c for c in w if c in _NOISE]
                odd = bool(signs) or (not n and lm.spelling(w) < ODD_SPELLING)
                forms = {f: c for f, c in candidates(w, two=not n).items() if bits[zlib.crc32(f.encode()) % SLOTS] or (odd and len(c) == 1)}
                if len(signs) > 1 and (best := _best_signs(w, lm, chance)):
                    forms.setdefault(*best)
                for f, c in forms.items():
                    for col, v in zip(out, (w, m, n, f, c)):
                        col.append(v)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["word", "m", "own", "form", "by"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(w, m, n, f, c, by) for w, m, n, f, c in zip(*(x.to_pylist() for x in batch.columns)) if (by := signs_undone(w, f))]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["word", "m", "own", "form", "n", "by"])

    schema = "word string, m long, own long, form string, by array<int>"
    proposed = arrow_stage(types.select("word", "m", "n"), propose, schema).join(words.toDF("form", "n"), "form", "left")
    proposed = proposed.select("word", "m", "own", "form", F.coalesce("n", F.lit(0)).alias("n"), "by")
    signs, to = "".join(map(chr, _KEY_OF)), "".join(_KEY_OF.values())
    key = lambda c: F.translate(c, signs, to)
    noisy = types.where(F.regexp_count("word", F.lit(r"[0-9|!]")) > 1).select("word", "m", F.col("n").alias("own"), key("word").alias("k"))
    by_key = noisy.join(words.select(F.col("key").alias("form"), "n", key("key").alias("k")).where("k rlike '[0159]'"), "k").select("word", "m", "own", "form", "n")
    proposed = proposed.unionByName(arrow_stage(by_key, keyed, "word string, m long, own long, form string, n long, by array<int>"))
    forms = F.collect_set(F.struct("form", "n", "by")).alias("forms")
    return materialise(proposed.groupBy("word").agg(F.first("m").alias("m"), F.first("own").alias("own"), forms))


def _chances(proposals: DataFrame, types: DataFrame, model: LanguageModel) -> np.ndarray:
    """Log probability of each confusion at a place where it can come about, by expectation and maximisation over the words of
    scanned texts that clean ones don't hold: each may be a new word, or any of its forms misread."""
    spark = proposals.sparkSession

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(PAIRS))
        for batch in batches:
            for w, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for c, (true, _) in enumerate(PAIRS):
                    if true in w:
                        out[c] += m * w.count(true)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(PAIRS))), pa.array(out)], ["c", "v"])

    def summed(frame: DataFrame) -> np.ndarray:
        out = np.zeros(len(PAIRS))
        for r in frame.groupBy("c").agg(F.sum("v").alias("v")).collect():  # a row for each confusion
            out[r.c] = r.v
        return out

    open_ = summed(arrow_stage(types.select("word", "m"), places, "c long, v double"))
    chance = np.full(len(PAIRS), math.log(ERROR))
    unknown = proposals.where("own = 0")
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((chance, model.tokens, model.once, model.triples, model.pairs))

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now, *tables = shared.value
            lm, out = LanguageModel(*tables), np.zeros(len(PAIRS))
            for batch in batches:
                for w, m, forms in zip(*(c.to_pylist() for c in batch.columns)):
                    weights = [math.exp(lm.score(f["form"], f["n"]) + sum(now[c] for c in f["by"])) for f in forms]
                    whole = sum(weights) + math.exp(lm.spelling(w))
                    for f, v in zip(forms, weights):
                        for c in f["by"]:
                            out[c] += m * v / whole if whole else 0.0
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(PAIRS))), pa.array(out)], ["c", "v"])

        found = summed(arrow_stage(unknown.select("word", "m", "forms"), expected, "c long, v double"))
        chance = np.log(np.clip((found + ERROR * PRIOR) / (open_ + PRIOR), 1e-6, MOST_ERROR))
    return chance


def _suspects(proposals: DataFrame, chance: np.ndarray, model: LanguageModel) -> DataFrame:
    """``(word, own, forms)``: words that some form may beat, with their own score and those of the forms."""
    shared = proposals.sparkSession.sparkContext.broadcast((chance, model.tokens, model.once, model.triples, model.pairs))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, *tables = shared.value
        lm = LanguageModel(*tables)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for w, n, forms in zip(*(c.to_pylist() for c in batch.columns)):
                here = lm.score(w, n)
                scored = [(lm.score(f["form"], f["n"]) + sum(now[c] for c in f["by"]), f["form"]) for f in forms]
                good = sorted((x for x in scored if x[0] > here - 4 * CONTEXT * MOST_CONTEXT), reverse=True)
                if good:
                    out[0].append(w)
                    out[1].append(here)
                    out[2].append([{"form": f, "score": s} for s, f in good])
            kind = pa.list_(pa.struct([("form", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], kind)], ["word", "own", "forms"])

    return arrow_stage(proposals.select("word", "own", "forms"), weigh, "word string, own double, forms array<struct<form: string, score: double>>")


def _pair_counts(clean: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``(pair, n)``: neighbouring words of the clean texts whose pair is marked in ``wanted``, joined by a blank."""
    shared = clean.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import regex

        findall, bits = regex.compile(TERM).findall, np.unpackbits(shared.value).astype(bool)
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pair", "n"])
            held.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = list(map(bare, terms_of(findall, t)))
                held.update(p for p in map(" ".join, zip(words, words[1:])) if bits[zlib.crc32(p.encode()) % SLOTS])
            if len(held) > 300_000:
                yield out()
        yield out()

    return arrow_stage(clean, stage, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _options(low: list[str], known: dict[str, tuple[float, list[tuple[str, float]]]]) -> list[list[tuple[str, float]]]:
    return [[(w, known[w][0]), *known[w][1]] if w in known else [(w, 0.0)] for w in low]


def _decode(low: list[str], known: dict[str, tuple[float, list[tuple[str, float]]]], pairs: dict[str, float]) -> list[str]:
    """The best word for each place of a line: Viterbi over the words read and their candidates."""
    states = _options(low, known)
    paths: list[list[tuple[float, int]]] = []
    for k, options in enumerate(states):
        here = []
        for form, s in options:
            if not k:
                here.append((s, 0))
            else:
                best = max(((p + CONTEXT * pairs.get(f"{last} {form}", 0.0), -i) for i, ((p, _), (last, _)) in enumerate(zip(paths[-1], states[k - 1]))))
                here.append((best[0] + s, -best[1]))
        paths.append(here)
    out = []
    at = max(range(len(paths[-1])), key=lambda i: (paths[-1][i][0], -i)) if paths else 0
    for k in range(len(paths) - 1, -1, -1):
        out.append(states[k][at][0])
        at = paths[k][at][1]
    return out[::-1]


def _cased(form: str, read: str) -> str:
    if read.isupper() and len(read) > 1:
        return form.upper()
    return form[:1].upper() + form[1:] if read[:1].isupper() else form


def _pointed(form: str, read: str) -> str:
    """``form`` with the points of ``read``, where letter stands for letter."""
    if read.isalnum() or len(bare(read)) != len(form):
        return form
    letters = iter(form)
    return "".join(c if ord(c) in _POINTS else next(letters) for c in read)


def _parts(form: str, read: str, places: list[tuple[int, int, int]]) -> list[tuple[tuple[int, int, int], str, bool]]:
    """``form`` divided over the places of the word read, and whether each place differs."""
    if len(places) == 1:
        return [(places[0], form, True)]
    size = places[0][2] - places[0][1]
    head = 0
    while head < min(len(form), len(read)) and form[head].lower() == read[head].lower():
        head += 1
    cut = size if head >= size else size + len(form) - len(read)
    return [(places[0], form[:cut], form[:cut].lower() != read[:size].lower()), (places[1], form[cut:], form[cut:].lower() != read[size:].lower())]


def repaired_pages(
    df: DataFrame,
    titles: DataFrame | None = None,
    row_id: str = "row_id",
    text: str = "text",
    is_pdf: str = "is_pdf",
    title: str = "title",
    group: str = "file_path",
    title_group: str = "file_path",
    title_text: str = "title",
) -> DataFrame:
    """``(row_id, text, marks)`` for the records from scanned pages.

    ``text``: the repaired text, continuous paragraphs without broken words, misread characters, headers and page
    numbers; ``marks``: ``(line_no, kind)`` of the lines read, ``kind`` one of ``hyphen``, ``misread``, ``header``, ``pageno``.
    The corpus model comes from all records that aren't scanned. ``titles`` gives further titles by ``group``, against which
    headers are held besides the record's own. Null texts and flags give no row, empty texts an empty one without
    marks; repeated ids are repaired alike; further columns are ignored.
    """
    rows = pick(df, row_id=row_id, t=text, pdf=is_pdf, title=title, grp=group)
    pages = rows.where("pdf and t is not null").select("row_id", "t", "title", "grp")
    if titles is None:
        pages = pages.withColumn("book", F.lit(None).cast("string"))
    else:
        books = pick(titles, grp=title_group, book=title_text).groupBy("grp").agg(F.min("book").alias("book"))
        pages = pages.join(books, "grp", "left")
    clean = rows.where("not coalesce(pdf, false) and t is not null").select("t")
    counts = materialise(_corpus_counts(clean))
    model = _model(counts)
    vocabulary = counts.where("kind = 'w'").select("key", "n")
    codes = {"text": "t", "blank": "b", "header": "h", "pageno": "p"}
    kind_of = {v: k for k, v in codes.items()}

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = Page()
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t, *names in zip(*(c.to_pylist() for c in batch.columns)):
                lines, kinds = page.kinds(t, names)
                words, broken = page.distinct(lines, kinds)
                for col, v in zip(out, (i, t, "".join(codes[k] for k in kinds), list(words), [{"word": w, "form": f} for w, f in broken])):
                    col.append(v)
            types = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("word", pa.string()), ("form", pa.string())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, types)], ["row_id", "t", "kinds", "words", "broken"])

    laid = materialise(arrow_stage(pages.select("row_id", "t", "title", "book"), lay_out, "row_id long, t string, kinds string, words array<string>, broken array<struct<word: string, form: string>>"))
    types = laid.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("m"))
    types = materialise(types.join(vocabulary.toDF("word", "n"), "word", "left").select("word", "m", F.coalesce("n", F.lit(0)).alias("n")))
    proposals = _proposals(types, counts, model)
    misread = _suspects(proposals, _chances(proposals, types, model), model)
    # a broken word keeps its hyphen where the clean texts have it so more often than as one word
    own_score = lambda n: F.log(F.greatest(n, F.lit(0.5)) / F.lit(float(model.tokens)))
    broken = laid.select(F.explode("broken").alias("b")).select("b.word", "b.form").distinct().join(counts.where("kind = 'c'").select(F.col("key").alias("form"), F.col("n").alias("c")), "form")
    broken = broken.join(vocabulary.toDF("word", "n"), "word", "left").where("c > coalesce(n, 0)")
    hyphened = broken.select("word", own_score(F.coalesce("n", F.lit(0))).alias("own"), F.array(F.struct("form", own_score(F.col("c")).alias("score"))).alias("forms"))
    both = misread.unionByName(hyphened).groupBy("word").agg(F.min("own").alias("own"), F.flatten(F.collect_list("forms")).alias("forms"))
    suspects = materialise(both)
    slot = F.pmod(F.crc32("word"), F.lit(1 << 20))
    slots = F.broadcast(suspects.select(slot.alias("slot")).distinct())  # 2 ** 20 rows at most; it may let others through
    found = laid.select("row_id", F.explode("words").alias("word")).withColumn("slot", slot).join(slots, "slot", "left_semi").drop("slot").distinct().join(suspects, "word")
    per_row = found.groupBy("row_id").agg(F.collect_list(F.struct("word", "own", "forms")).alias("suspects"))
    held = materialise(laid.select("row_id", "t", "kinds").join(per_row, "row_id", "left"))

    def lines_of(page: Page, t: str, kinds: str, suspects_: list | None):
        """Lines, kinds, breaks and suspects of a page, and of each line with a suspect its words as read and in bare form."""
        lines, named = t.split("\n"), [kind_of[c] for c in kinds]
        breaks = page.breaks(lines, named)
        known = {x["word"]: (x["own"], [(f["form"], f["score"]) for f in x["forms"]]) for x in suspects_ or ()}
        told = []
        for k, kind in enumerate(named):
            if known and kind == "text":
                line = page.line(lines, k, breaks)
                low = [bare(w.lower()) for w, _ in line]
                if not known.keys().isdisjoint(low):
                    told.append((line, low))
        return lines, named, breaks, known, told

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = Page()
        for batch in batches:
            ids, us, vs = [], [], []
            for i, t, kinds, suspects_ in zip(*(c.to_pylist() for c in batch.columns)):
                *_, known, told = lines_of(page, t, kinds, suspects_)
                pairs = set()
                for _, low in told:
                    options = _options(low, known)
                    for a, b in zip(options, options[1:]):
                        if len(a) > 1 or len(b) > 1:
                            pairs |= {(u, v) for u, _ in a for v, _ in b}
                for u, v in pairs:
                    ids.append(i)
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(us, pa.string()), pa.array(vs, pa.string())], ["row_id", "u", "v"])

    beside = materialise(arrow_stage(held.where("suspects is not null"), neighbours, "row_id long, u string, v string").distinct())
    asked = beside.select("u", "v").distinct().withColumn("pair", F.concat_ws(" ", "u", "v"))
    counted = _pair_counts(clean, _marked(asked.select("pair")))
    told = asked.join(counted.withColumnRenamed("n", "both"), "pair").join(vocabulary.toDF("u", "nu"), "u").join(vocabulary.toDF("v", "nv"), "v")
    lift = F.log((F.col("both") + PAIR_PRIOR) / (F.col("nu") * F.col("nv") / F.lit(float(model.tokens)) + PAIR_PRIOR))
    lifts = told.select("u", "v", F.greatest(F.lit(-MOST_CONTEXT), F.least(F.lit(MOST_CONTEXT), lift)).alias("lift"))
    contexts = beside.join(lifts, ["u", "v"]).groupBy("row_id").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(" ", "u", "v"), "lift"))).alias("lifts"))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = Page()
        for batch in batches:
            ids, texts, marks = [], [], []
            for i, t, kinds, suspects_, lifts_ in zip(*(c.to_pylist() for c in batch.columns)):
                lines, named, breaks, known, told = lines_of(page, t, kinds, suspects_)
                pairs = dict(lifts_ or ())
                misread: set[int] = set()
                kept: set[int] = set()
                changes: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
                for line, low in told:
                    for (read, places), w, best in zip(line, low, _decode(low, known, pairs)):
                        if best == w:
                            continue
                        if len(places) > 1 and best.translate(_NO_HYPHEN) == w:
                            kept.add(places[0][0])
                            continue
                        for (at, a, b), part, differs in _parts(_cased(_pointed(best, read), read), read, places):
                            if differs:
                                misread.add(at)
                                changes[at].append((a, b, part))
                ids.append(i)
                texts.append(_join(lines, named, breaks, changes, kept))
                found_ = [(k, "hyphen") for k in breaks] + [(k, "misread") for k in misread] + [(k, x) for k, x in enumerate(named) if x in ("header", "pageno")]
                marks.append([{"line_no": k, "kind": x} for k, x in sorted(found_)])
            kind = pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(marks, kind)], ["row_id", "text", "marks"])

    return arrow_stage(held.join(contexts, "row_id", "left").select("row_id", "t", "kinds", "suspects", "lifts"), repair, "row_id long, text string, marks array<struct<line_no: bigint, kind: string>>")


_NO_HYPHEN = dict.fromkeys(map(ord, HYPHENS))


def _join(lines: list[str], kinds: list[str], breaks: dict[int, int], changes: dict[int, list[tuple[int, int, str]]], kept: set[int] = frozenset()) -> str:
    """The running lines as paragraphs; a hyphen at a line's end stays where it is in ``kept``. A blank line ends a paragraph unless a word is broken before it or it only stands beside a page's end."""
    out: list[str] = []
    gap = ""
    pending = False
    for k, (line, kind) in enumerate(zip(lines, kinds)):
        if kind == "blank":
            beside = (k and kinds[k - 1] in ("header", "pageno")) or (k + 1 < len(kinds) and kinds[k + 1] in ("header", "pageno"))
            if not pending and out and not beside:
                gap = "\n\n"
            continue
        if kind != "text":
            continue
        for a, b, part in sorted(changes.get(k, ()), reverse=True):
            line = line[:a] + part + line[b:]
        line = line.strip()
        out += [gap, line] if out else [line]
        pending = k in breaks
        if pending:
            out[-1] = line if k in kept else line.rstrip(HYPHENS)
        gap = "" if pending else " "
    return "".join(out)


def page_marks(repaired: DataFrame) -> DataFrame:
    """``(row_id, line_no, kind)``, one row per line and kind."""
    return repaired.select("row_id", F.explode("marks").alias("m")).select("row_id", "m.line_no", "m.kind").distinct()
