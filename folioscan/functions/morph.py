"""The compiler of advanced queries: words with options become whole-term patterns.

Everything here is a function of strings and runs on the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from folioscan.functions.analysis import unmarked

# The names of the options per word.
TYPO = "שגיאות כתיב"
PREFIX = "קידומות"
SUFFIX = "סיומות"
GRAM_PREFIX = "קידומות דקדוקיות"
GRAM_SUFFIX = "סיומות דקדוקיות"
SPELLING = "כתיב מלא/חסר"
PARTIAL = "חלק ממילה"
WIDENING = (PREFIX, SUFFIX, GRAM_PREFIX, GRAM_SUFFIX, PARTIAL)

# Particles before a word, possessive and plural endings after it.
SECOND_PARTICLES = "(?:כ|ב|ש|ל|ה|ד)?(?:ה)?"
RICH_PARTICLES = "(?:ו|מ|דא|א|כש|כ|ב|ש|ל|ה|ד)?" + SECOND_PARTICLES
LEAN_PARTICLES = "(?:ו|מ|כ|ב|ש|ל|ה|ד)?" + SECOND_PARTICLES
ENDINGS = "(?:ותי|ותיך|ותיו|ותיה|ותינו|ותיכם|ותיכן|ותיהם|ותיהן|יי|יך|יו|יה|ינו|יכם|יכן|יהם|יהן|י|ך|ו|ה|נו|כם|כן|ם|ן|ים|ות)?"
ALL_ENDINGS = "(?:ותי|ותיך|ותיו|ותיה|ותינו|ותיכם|ותיכן|ותיהם|ותיהן|יות|יי|יך|יו|יה|יא|תא|ינו|יכם|יכן|יהם|יהן|י|ך|ו|ה|נו|כם|כן|ם|ן|ים|ות)?"
# Letters that are mistaken for one another, and letters tried where one may be missing.
MISTAKEN = {"א": "עה", "ע": "אה", "ה": "אעח", "ח": "ה", "ו": "ב", "ב": "ו", "כ": "ק", "ק": "כ", "ט": "ת", "ת": "ט", "ס": "ש", "ש": "ס", "צ": "ז", "ז": "צ"}
MISSING = "ויאהפלמנבכשתר"
# Budgets.
LONGEST_PATTERN = 1000
TYPO_BRANCHES, BRANCHES = 48, 20
MOST_OPTIONAL = 20
LARGEST_SLOP = (1 << 32) - 1

_DROPPED = set(",;!?:*()[]{}^$|\\+.~`")
_SPECIAL = set("\\.+*?()|[]{}^$")
_REPLACED = {"״": '"', "׳": "'", "־": " ", "-": " "}


@dataclass(frozen=True)
class AdvancedQuery:
    """Patterns, one per word, with the slop of the phrase and the most terms that they may expand to."""

    regex_terms: list[str] = field(default_factory=list)
    slop: int = 0
    max_expansions: int = 10


@dataclass(frozen=True)
class WordFlags:
    typo: bool = False
    prefix: bool = False
    suffix: bool = False
    gram_prefix: bool = False
    gram_suffix: bool = False
    spelling: bool = False
    partial: bool = False

    @classmethod
    def of(cls, options: dict[str, bool] | None) -> WordFlags:
        chosen = options or {}
        names = (TYPO, PREFIX, SUFFIX, GRAM_PREFIX, GRAM_SUFFIX, SPELLING, PARTIAL)
        return cls(*(bool(chosen.get(n)) for n in names))


def sanitize_query(query: str) -> str:
    """Plain quotes, blanks for hyphens, no punctuation, single blanks."""
    kept = (_REPLACED.get(c, c) for c in query if c not in _DROPPED)
    return " ".join("".join(kept).split())


def _in_word(c: str) -> bool:
    return (c.isascii() and c.isalnum()) or "א" <= c <= "ת" or "֐" <= c <= "ׇ"


def split_query_words(query: str) -> list[str]:
    """Runs of word characters; an apostrophe stays with the word that it ends."""
    text = sanitize_query(query)
    words: list[str] = []
    at = 0
    for inside, run in itertools.groupby(text, _in_word):
        size = sum(1 for _ in run)
        if inside:
            words.append(text[at : at + size])
        elif words and text[at] == "'" and (size > 1 or at + 1 == len(text)):
            words[-1] += "'"
        at += size
    return words


def escape_regex(word: str) -> str:
    return "".join("\\" + c if c in _SPECIAL else c for c in word)


def spelling_variations(word: str) -> list[str]:
    """The word with each of its optional letters left out or kept, fewest first in counting order."""
    optional = [i for i, c in enumerate(word) if c in "יו'\""]
    if len(optional) > MOST_OPTIONAL:
        return [word]
    found: dict[str, None] = {}
    for mask in range(1 << len(optional)):
        gone = {i for bit, i in enumerate(optional) if not mask >> bit & 1}
        found.setdefault("".join(c for i, c in enumerate(word) if i not in gone))
    return list(found)


def _letters(word: str) -> list[str]:
    import regex

    return regex.findall(r"\X", word)


def _confused(letters: list[str]) -> Iterator[list[str]]:
    yield letters
    for i, c in enumerate(letters):
        for other in MISTAKEN.get(c, ""):
            yield [*letters[:i], other, *letters[i + 1 :]]
    for i, (a, b) in enumerate(itertools.pairwise(letters)):
        if a != b:
            yield [*letters[:i], b, a, *letters[i + 2 :]]


def _edited(letters: list[str]) -> Iterator[list[str]]:
    yield from _confused(letters)
    for i in range(len(letters)):
        yield letters[:i] + letters[i + 1 :]
    for i in (0, len(letters), *range(1, len(letters))):
        for c in MISSING:
            yield [*letters[:i], c, *letters[i:]]


def _unique(forms: Iterable[list[str]]) -> Iterator[str]:
    seen: set[str] = set()
    for letters in forms:
        form = "".join(letters)
        if form not in seen:
            seen.add(form)
            yield form


def common_typo_variations(word: str) -> list[str]:
    """The word, then with letters mistaken, then with neighbours exchanged."""
    return list(_unique(_confused(_letters(word)))) if word else [""]


def typo_variations(word: str, most: int = TYPO_BRANCHES) -> list[str]:
    """Words one edit away: the common ones, then with a letter less, then with one more; ``most`` at most."""
    if not word:
        return [""]
    return list(itertools.islice((f for f in _unique(_edited(_letters(word))) if f), most))


def _window(size: int, *by_size: int) -> int:
    return by_size[min(size, len(by_size)) - 1]


def _before(root: str) -> str:
    return f".{{0,{_window(len(root), 5, 4, 3)}}}{escape_regex(root)}"


def _after(root: str) -> str:
    return f"{escape_regex(root)}.{{0,{_window(len(root), 7, 6, 5)}}}"


def _around(root: str) -> str:
    gap = f".{{0,{_window(len(root), 3, 3, 3, 2)}}}"
    return gap + escape_regex(root) + gap


def _inflected(root: str) -> str:
    return LEAN_PARTICLES + escape_regex(root) + ALL_ENDINGS


def _with_particles(root: str) -> str:
    return RICH_PARTICLES + escape_regex(root)


def _with_endings(root: str) -> str:
    return escape_regex(root) + ENDINGS


#: The first row whose flags are all set tells how a root is widened, and how many spellings at most.
_WIDENINGS: list[tuple[tuple[str, ...], Callable[[str], str], int]] = [
    (("prefix", "suffix"), _around, 16),
    (("gram_prefix", "gram_suffix"), _inflected, 4),
    (("prefix",), _before, 16),
    (("suffix",), _after, 16),
    (("gram_prefix",), _with_particles, 10),
    (("gram_suffix",), _with_endings, 6),
    (("partial",), _around, 16),
    ((), escape_regex, 16),
]


def word_to_pattern(root: str, flags: WordFlags) -> str:
    """The pattern of one root. An empty root stays empty, so it never becomes a wildcard."""
    if not root:
        return ""
    widen, most = next((w, n) for needed, w, n in _WIDENINGS if all(getattr(flags, f) for f in needed))
    if not flags.spelling:
        return widen(root)
    return f"(?:{'|'.join(widen(v) if v else '' for v in spelling_variations(root)[:most])})"


def build_word_regex(word: str, flags: WordFlags, alternatives: Iterable[str] = ()) -> str:
    """One pattern for a word and its alternatives, within the budgets of branches and length.

    Branches are spent in order, so with typos the word's own variants can leave none for the alternatives.
    """
    roots = [r for r in (word, *(unmarked(a).lower() for a in alternatives)) if r.strip()]
    fanned = (v for r in roots for v in (typo_variations(r) if flags.typo else [r]))
    found: dict[str, None] = {}
    for root in fanned:
        found.setdefault(word_to_pattern(root, flags))
        if len(found) >= (TYPO_BRANCHES if flags.typo else BRANCHES):
            break
    kept, total = [], 0
    for branch in found:
        if not branch.strip():
            continue
        if kept and total + len(branch) > LONGEST_PATTERN:
            break
        kept.append(branch)
        total += len(branch)
    pattern = kept[0] if len(kept) == 1 else f"(?:{'|'.join(kept)})"
    return pattern if kept and len(pattern) <= LONGEST_PATTERN else escape_regex(word)


def parse_custom_spacing(spacing: dict[str, str], words: int) -> list[int]:
    """The spacing of each pair of neighbours; what is missing, no number or not positive counts as 0."""

    def one(value: str | None) -> int:
        try:
            n = int(value.strip()) if value is not None and "_" not in value else 0
        except ValueError:
            return 0
        return min(n, LARGEST_SLOP) if 0 < n < 1 << 63 else 0

    return [one(spacing.get(f"{i}-{i + 1}")) for i in range(max(words - 1, 0))]


def compute_max_expansions(words: list[str], options: dict[str, dict[str, bool]]) -> int:
    """How many terms the patterns may expand to: few for plain words, many for short widened ones."""
    many = len(words) > 1
    if any(o.get(TYPO) for o in options.values()):
        return 100 if many else 50
    widened = [len(w) for i, w in enumerate(words) if any(options.get(f"{w}_{i}", {}).get(k) for k in WIDENING)]
    if widened:
        return 1000 + 1000 * min(max(min(widened), 1), 4)
    return 100 if many else 10


def prepare_advanced_query(
    query: str,
    distance: int = 0,
    custom_spacing: dict[str, str] | None = None,
    alternative_words: dict[int, list[str]] | None = None,
    search_options: dict[str, dict[str, bool]] | None = None,
) -> AdvancedQuery:
    """The compiled query. Options are looked up by the word as normalised and its place; a custom spacing that isn't
    empty overrides ``distance`` even if all of it is 0."""
    spacing, alternatives, options = custom_spacing or {}, alternative_words or {}, search_options or {}
    words = split_query_words(unmarked(query).lower())
    slop = 0
    if len(words) > 1:
        slop = max(parse_custom_spacing(spacing, len(words))) if spacing else distance
    if not alternatives and not any(v for o in options.values() for v in o.values()):
        return AdvancedQuery([escape_regex(w) for w in words], slop, 100 if len(words) > 1 else 10)
    terms = [build_word_regex(w, WordFlags.of(options.get(f"{w}_{i}")), alternatives.get(i, ())) for i, w in enumerate(words)]
    return AdvancedQuery(terms, slop, compute_max_expansions(words, options))
