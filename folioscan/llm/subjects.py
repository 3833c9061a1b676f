"""Subject areas of documents from weighted terms, matched with a multi-pattern automaton."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscan.llm.common import pick
from folioscan.llm.leakage import MARKS, WORD, Matcher, kept_text, normalised, over_cleaned

#: Labelled rows read for the terms: at most so many, the first by id.
MAX_EXAMPLES = 20_000
#: A term counts if it is in at least MIN_SUPPORT examples, PURITY of them of one subject.
MIN_SUPPORT, PURITY = 2, 0.8
#: Share of the median score of a subject's held-out examples from which the subject counts; a half text reaches 0.5, a passing mention 0.1.
THRESHOLD = 0.2
#: Parts of the examples; each is held out once to calibrate the thresholds.
FOLDS = 5
#: Hebrew particles that are written together with the next word, and the Aramaic ending.
PARTICLES, ENDING = "ובכלמשהד", "א"


def stems(word: str) -> set[str]:
    """``word`` and what it is without up to two leading particles and without the ending."""
    out = {word}
    if "א" <= word[0] <= "ת":
        for k in (1, 2):
            if len(word) > k + 1 and all(c in PARTICLES for c in word[:k]):
                out.add(word[k:])
        out |= {w[:-1] for w in out if len(w) > 3 and w.endswith(ENDING)}
    return out


class SubjectModel:
    """Weighted terms of each subject, and for each the score from which a text is about it."""

    def __init__(self, examples: list[tuple[str, str]], threshold: float = THRESHOLD):
        import regex

        strip_marks, words = regex.compile(MARKS).sub, regex.compile(WORD).findall
        texts = [(s, normalised(t, strip_marks, words)) for s, t in examples]
        held_out: dict[str, list[float]] = defaultdict(list)
        for k in range(FOLDS):
            automaton = _automaton(_patterns([x for n, x in enumerate(texts) if n % FOLDS != k]))
            for subject, found in texts[k::FOLDS]:
                held_out[subject].append(score(automaton, found).get(subject, 0.0))
        self.patterns = _patterns(texts)
        whole = median(v for x in held_out.values() for v in x) if held_out else 1.0
        # a subject of very few examples can't be calibrated by itself: half of what is usual holds for it at least
        self.least = {s: threshold * max(median(v), whole / 2) for s, v in held_out.items()}


def _patterns(texts: list[tuple[str, list[str]]]) -> dict[str, tuple[str, float]]:
    """Forms of the terms that mark one subject, each with the subject and a weight by purity and rarity."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for subject, found in texts:
        for stem in set().union(*map(stems, found)) if found else ():
            seen[stem][subject] += 1
    n = len(texts)
    terms: dict[str, tuple[str, float]] = {}
    for stem, by in seen.items():
        total = sum(by.values())
        subject, most = min(by.items(), key=lambda x: (-x[1], x[0]))
        if len(stem) > 1 and total >= MIN_SUPPORT and most / total >= PURITY:
            terms[stem] = (subject, most / total * math.log(1 + n / total) / math.log(1 + n / MIN_SUPPORT))
    patterns: dict[str, tuple[str, float]] = {}
    for stem in sorted(terms, key=lambda s: (len(s), s)):  # a longer stem overrides a shorter one
        forms = {stem}
        if "א" <= stem[0] <= "ת":
            forms |= {stem + ENDING}
            forms |= {p + f for f in list(forms) for p in PARTICLES} | {p + q + f for f in list(forms) for p in PARTICLES for q in PARTICLES}
        for form in forms:
            if form == stem or form not in terms:
                patterns[form] = terms[stem]
    return patterns


def _automaton(patterns: dict[str, tuple[str, float]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for form, value in patterns.items():
        out.add_word(f" {form} ", value)
    if patterns:
        out.make_automaton()
    return out


def score(automaton, words: list[str]) -> dict[str, float]:
    """Weight of each subject's terms in ``words``, over their number."""
    sums: dict[str, float] = defaultdict(float)
    if words and len(automaton):
        for _, (subject, weight) in automaton.iter(f" {' '.join(words)} "):
            sums[subject] += weight
    return {s: v / len(words) for s, v in sums.items()}


def fit_subjects(examples: DataFrame, example_id: str = "example_id", subject: str = "subject", text: str = "text", threshold: float = THRESHOLD) -> SubjectModel:
    """The model of a bounded set of labelled rows: the first ``MAX_EXAMPLES`` by id, without null subjects or texts."""
    rows = pick(examples, i=example_id, s=subject, t=text).where("s is not null and t is not null").orderBy("i", "s", "t").limit(MAX_EXAMPLES)
    return SubjectModel([(r.s, r.t) for r in rows.toLocalIterator()], threshold)


def subject_areas(
    documents: DataFrame, model: SubjectModel, quoted: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Rows ``(doc_id, subject, score)`` for every subject whose score reaches the model's threshold for it.

    The score is the summed weight of the subject's terms over the number of words. ``quoted``: items whose passages
    don't count and are taken out first, in the same stage. Null, empty and foreign texts give no rows; a repeated document
    its rows again; further columns are ignored.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast((model.patterns, model.least))
    if quoted is None:
        quoted = spark.createDataFrame([], "item_id long, text string")
        item_id, item_text = "item_id", "text"

    def emit(matcher: Matcher) -> Callable[[list], pa.RecordBatch]:
        patterns, least = shared.value
        automaton = _automaton(patterns)

        def batch(rows: list) -> pa.RecordBatch:
            out: tuple[list, list, list] = ([], [], [])
            for d, t, spans, words in rows:
                for s, v in score(automaton, matcher.plain(kept_text(t, spans)) if spans else words).items():
                    if v >= least[s]:
                        for col, x in zip(out, (d, s, round(v, 6))):
                            col.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.float64()))], ["doc_id", "subject", "score"])

        return batch

    return over_cleaned(documents, quoted, emit, "doc_id long, subject string, score double", doc_id, text, item_id, item_text)
