"""One form for texts that look alike: skeletons of confusable characters, and canonical forms that share them.

The look-alike table is the public one of Unicode, whole, as the ICU library in Spark's own jars has it; a few rows are added to it here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm.common import arrow_stage, pick

# Letters that look alike beyond what the public table holds, prototype first.
LOOK_ALIKE = ["k κ к", "m м", "n п η ח", "t т τ", "u υ", "v ѵ", "w ԝ ω", "y у γ", "b Ь", "p р ρ", "i і ι", "G Ԍ", "M М", "V Ѵ", "Y Ү Υ"]
# Hebrew letters and those of other scripts that stand in for them in a Hebrew word.
HEBREW_LOOK_ALIKE = ["ו ı ן", "ס о ο", "ח п", "ט υ", "י ʹ"]
# Ready-made letter pairs without a decomposition of their own.
PAIRS = {"װ": "וו", "ױ": "וי", "ײ": "יי"}
#: Characters that show nothing (format characters, joiners, fillers, variation selectors).
INVISIBLE = r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ]"
#: Spaces other than U+0020; line breaks and tabs are none.
OTHER_SPACE = r"[\p{Zs}-- ]"
_SCRIPTS = ("Latin", "Hebrew", "Cyrillic", "Greek", "Arabic", "Armenian")


_prototypes: dict[str, dict[int, str]] = {}


def prototypes(spark: SparkSession) -> dict[int, str]:
    """Prototype of each character that has one: the public table of confusables, read once from the ICU library of Spark's JVM
    for all characters of the first two planes, with the groups of ``LOOK_ALIKE`` joined. Its size is that of Unicode."""
    import unicodedata

    key = spark.sparkContext.applicationId
    if key not in _prototypes:
        points = [p for p in range(0x20, 0x20000) if unicodedata.category(chr(p)) not in ("Cn", "Cs", "Co", "Cc")]
        between = "\x01"
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        found = dict(zip(points, checker.getSkeleton(between.join(map(chr, points))).split(between)))
        _prototypes[key] = joined(found)
    return _prototypes[key]


def joined(found: dict[int, str]) -> dict[int, str]:
    """``found`` with the prototypes of each row of ``LOOK_ALIKE`` made one, for all characters that have them."""
    one = lambda c: found.get(ord(c), c)
    top: dict[str, str] = {}

    def last(p: str) -> str:
        while p in top:
            p = top[p]
        return p

    for row in LOOK_ALIKE:
        first, *others = row.split()
        for c in others:
            if last(one(c)) != last(one(first)):
                top[last(one(c))] = last(one(first))
    out = {}
    for point in found.keys() | {ord(p) for p in top if len(p) == 1}:
        p = found.get(point, chr(point))
        p = last(p) if p in top else "".join(map(last, p))
        if p != chr(point):
            out[point] = p
    return out


def _by_script(proto: dict[int, str]) -> dict[str, dict[str, str]]:
    """For each script the letter of it that a foreign letter stands for: one with the same prototype, of the same case if
    there is one, the first in order."""
    import unicodedata

    import regex

    members = {s: [c for c in map(chr, range(0x41, 0x600)) if unicodedata.category(c)[0] == "L" and regex.match(rf"\p{{Script={s}}}", c)] for s in _SCRIPTS}
    into: dict[str, dict[str, str]] = {}
    for s in _SCRIPTS:
        own: dict[str, list[str]] = {}
        for c in members[s]:
            if unicodedata.normalize("NFD", c) == c:
                own.setdefault(proto.get(ord(c), c), []).append(c)
        into[s] = {}
        for other in _SCRIPTS:
            for c in members[other] if other != s else ():
                found = own.get(proto.get(ord(c), c))
                if found:
                    into[s][c] = next((x for x in found if x.isupper() == c.isupper()), found[0])
    for row in HEBREW_LOOK_ALIKE:
        letter, *others = row.split()
        for c in others:
            if not "א" <= c <= "ת":
                into["Hebrew"][c] = letter
    return into


class _Codes(dict):
    """For ``str.translate``: a letter's script as one character, ``m`` for marks, a blank for all else."""

    def __init__(self) -> None:
        import regex

        super().__init__()
        self.scripts = [regex.compile(rf"\p{{Script={s}}}").match for s in _SCRIPTS]

    def __missing__(self, point: int) -> str:
        import unicodedata

        c, code = chr(point), " "
        kind = unicodedata.category(c)[0]
        if kind == "M":
            code = "m"
        elif kind == "L":
            code = next((str(k) for k, match in enumerate(self.scripts) if match(c)), "x")
        self[point] = code
        return code


class Former:
    """Brings one value after another to its canonical form or skeleton."""

    def __init__(self, proto: dict[int, str]) -> None:
        import re

        import regex

        self.invisible, self.space = regex.compile(INVISIBLE).sub, regex.compile(OTHER_SPACE, regex.V1).sub
        self.odd = regex.compile(rf"{INVISIBLE}|{OTHER_SPACE}|[{''.join(PAIRS)}]", regex.V1).search
        self.codes = _Codes()
        digits = "".join(str(k) for k in range(len(_SCRIPTS)))
        self.meet = re.compile("|".join(f"{d}m*[{digits.replace(d, '')}]" for d in digits)).search
        self.word = regex.compile(r"[\p{L}\p{M}]+").sub
        self.proto, self.into = proto, _by_script(proto)
        self.pair = str.maketrans(PAIRS)

    def canonical(self, text: str) -> str:
        """Compatibility composition without invisible characters, plain spaces only, each word in one script.

        Text that is in this form comes back unchanged, line breaks included.
        """
        import unicodedata

        if text.isascii():
            return text
        out = text
        if self.odd(out):
            out = self.space(" ", self.invisible("", out)).translate(self.pair)
        if not unicodedata.is_normalized("NFKC", out):
            out = unicodedata.normalize("NFKC", out)
        if self.mixed_word(out):
            out = self.word(self._one_script, out)
        return out

    def _one_script(self, m) -> str:
        word = m.group()
        codes = word.translate(self.codes)
        count = {s: codes.count(str(k)) for k, s in enumerate(_SCRIPTS)}
        if sum(n > 0 for n in count.values()) < 2:
            return word
        table = self.into[max(_SCRIPTS, key=count.__getitem__)]
        return "".join(table.get(c, c) for c in word)

    def mixed_word(self, text: str) -> bool:
        """Whether letters of two scripts stand side by side in a word, look-alike or not."""
        if text.isascii() or len({self.codes[ord(c)] for c in set(text)} - {" ", "m", "x"}) < 2:
            return False
        return self.meet(text.translate(self.codes)) is not None

    def skeleton(self, text: str) -> str:
        """Decompose, put the prototype for every character, decompose again; invisible characters have no place in it.

        Spaces have one prototype, and compatibility forms those of what they are a form of.
        """
        import unicodedata

        if not text.isascii():
            if self.odd(text):
                text = self.space(" ", self.invisible("", text)).translate(self.pair)
            text = unicodedata.normalize("NFKD", text)
        out = text.translate(self.proto)
        return out if out.isascii() else unicodedata.normalize("NFKD", out)

    def form(self, text: str) -> tuple[str, str, bool]:
        """Canonical form and skeleton of ``text``, and whether it is a look-alike: not the canonical one of those that share its skeleton.

        A word that keeps letters of two scripts, look-alike or not, makes any text one.
        """
        skeleton, form = self.skeleton(text), self.canonical(text)
        return form, skeleton, self.mixed_word(text) or (form != text and self.skeleton(form) == skeleton)


def canonical_forms(df: DataFrame, row_id: str = "row_id", fields: tuple[str, ...] = ("title", "text"), whole: bool = True) -> DataFrame:
    """Rows ``(row_id, field, form, form_key, skeleton, changed)`` for each value of ``fields`` that isn't null.

    ``form`` is the canonical form (null unless ``whole``) and ``form_key`` its hash; ``skeleton``, a hash of 128 bits of the confusables skeleton of the value as it
    stands, is equal for values that look alike; ``changed`` tells whether the value is another than the canonical one of
    its skeleton. Empty values stay empty; repeated rows come out again; further columns are ignored.
    """
    names = list(fields)
    shared = df.sparkSession.sparkContext.broadcast(prototypes(df.sparkSession))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        former = Former(shared.value)
        key = lambda v: xxhash.xxh3_128_hexdigest(v.encode("utf-8", "surrogatepass"))
        seen: dict[str, tuple[str | None, str, str, bool]] = {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            ids = batch.column(0).to_pylist()
            for k, name in enumerate(names):
                for i, v in zip(ids, batch.column(k + 1).to_pylist()):
                    if v is None:
                        continue
                    got = seen.get(v) if len(v) < 100 else None
                    if got is None:
                        form, skeleton, changed = former.form(v)
                        got = form if whole else None, key(form), key(skeleton), changed
                        if len(v) < 100:
                            if len(seen) > 20_000:
                                seen.clear()
                            seen[v] = got
                    for col, x in zip(out, (i, name, *got)):
                        col.append(x)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["row_id", "field", "form", "form_key", "skeleton", "changed"])

    columns = pick(df, row_id=row_id, **{f"v{k}": n for k, n in enumerate(names)})
    return arrow_stage(columns, stage, "row_id long, field string, form string, form_key string, skeleton string, changed boolean")


def look_alike_groups(forms: DataFrame) -> DataFrame:
    """``(field, skeleton, row_id, forms, rows, changed_rows)``: values grouped by equal skeleton.

    ``row_id`` is the first record with the group's commonest canonical form, which stands for the group; ``forms`` how
    many such forms it has. Counts per form come first, so a group of any size is a few pre-aggregated rows; of equally
    frequent forms the one that a lesser ``row_id`` has stands for the group.
    """
    by_form = forms.groupBy("field", "skeleton", "form_key").agg(F.count("*").alias("n"), F.sum(F.col("changed").cast("long")).alias("c"), F.min("row_id").alias("row_id"))
    best = F.max_by("row_id", F.struct("n", -F.col("row_id"))).alias("row_id")
    return by_form.groupBy("field", "skeleton").agg(best, F.count("*").alias("forms"), F.sum("n").alias("rows"), F.sum("c").alias("changed_rows"))


def matched_titles(df: DataFrame, titles: DataFrame, row_id: str = "row_id", title: str = "title", listed: str = "title") -> DataFrame:
    """``(row_id, listed)``: for each record whose title looks like one of ``titles`` the title listed, found by equal skeleton.

    Listed titles that look alike are told each; null titles match nothing; further columns are ignored.
    """
    books = canonical_forms(pick(titles, t=listed).where("t is not null").distinct().withColumn("k", F.lit(0).cast("long")), "k", ("t",)).select("form", "skeleton").distinct()
    return canonical_forms(df, row_id, (title,), whole=False).select("row_id", "skeleton").join(books, "skeleton").select("row_id", F.col("form").alias("listed"))
