"""One form for texts that look the same.

A transducer is compiled once in each worker from Unicode's own tables and a list of look-alikes. Its table
has every cluster of a character and the marks on it that changes, in a word with Latin letters and elsewhere:
characters of other widths, all ways in which an accented letter or a syllable can be written, look-alikes with
and without accents, and characters that are dropped. It reads a text once, takes the longest cluster at each place,
and looks it up; a run of white space is one space. What no table can list, any number of marks in any order, is
put into order by the same tables.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain, product

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirestone.operators.skew import hot_keys, join_spread, repeat, spread
from quirestone.session import written

# Cyrillic and Greek letters printed like a Latin letter, each before its Latin one.
LOOK_ALIKES = """
А A  В B  Е E  Ѕ S  І I  Ј J  К K  М M  Н H  О O  Р P  С C  Т T  Х X  Ԛ Q  Ԝ W
а a  е e  ѕ s  і i  ј j  о o  р p  с c  у y  х x  һ h  ԁ d  ԛ q  ԝ w
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X  ο o  ϲ c  Ϲ C  ϳ j  Ϳ J
"""

#: A run of white space or of anything else.
_SCAN = re.compile(r"\s+|\S+")
#: A character with all marks, format characters and half-width sound marks that follow it, and Hangul letters that join.
_CLUSTER = regex.compile(r"[ᄀ-ᅟꥠ-ꥼ]+[ᅠ-ᇿힰ-ퟻ\p{M}\p{Cf}]*|.[\p{M}\p{Cf}ﾞﾟᅠ-ᇿힰ-ퟻ]*", regex.DOTALL)
_WORD = regex.compile(r"[\p{L}\p{M}\p{Nd}\p{Cf}]")
_LATIN = regex.compile(r"[\p{Script=Latin}&&\p{L}]", regex.V1)
#: Longest run whose output is kept, and how many are.
_KEPT_RUN, _KEPT = 24, 200_000


class _Clusters(dict):
    """The table of one context; a cluster that isn't in it is put into order, if it is more than one character."""

    def __init__(self, table: dict[str, str], transducer: Transducer, latin: bool):
        super().__init__(table)
        self.transducer, self.latin = transducer, latin

    def __missing__(self, cluster: str) -> str:
        return cluster if len(cluster) == 1 else self.transducer.ordered(cluster, self.latin)


class _Runs(dict):
    """Outputs of whole runs of a text; short ones are kept."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, run: str) -> str:
        out = " " if run.isspace() else run if run.isascii() else self.transducer.token(run)
        if len(run) <= _KEPT_RUN and len(self) < _KEPT:
            self[run] = out
        return out


class Transducer:
    """The compiled mapping; call it with a text."""

    def __init__(self) -> None:
        pairs = LOOK_ALIKES.split()
        if len(set(pairs[::2])) != len(pairs) // 2 or set(pairs[::2]) & set(pairs[1::2]):
            raise ValueError("a letter has two look-alikes, or a look-alike has one itself")
        self.look = dict(zip(pairs[::2], pairs[1::2]))
        self._read_unicode()
        self.latin, self.plain = _Clusters(self._compiled(True), self, True), _Clusters(self._compiled(False), self, False)
        # characters that change by themselves or what is before them, and those that change beside a Latin letter
        active = {c for c in self.apart if self.plain[c] != c} | {y for _, y in self.pair} | set(self.mark)
        odd = {c for c in self.latin if len(c) == 1 and self.latin[c] != self.plain[c]}
        some = lambda chars: re.compile("[" + "".join(map(re.escape, sorted(chars))) + "]")
        self.active, self.odd = some(active), some(odd)
        self.runs = _Runs(self)

    def _read_unicode(self) -> None:
        """Tables by character: what it stands for, fully taken apart; classes of marks; pairs that become one character."""
        self.apart: dict[str, str] = {}
        self.mark: dict[str, int] = {}
        self.pair: dict[tuple[str, str], str] = {}
        self.widths: dict[str, list[str]] = {}
        direct: dict[str, str] = {}
        for code in chain(range(0x33000), range(0xE0000, 0xE1000)):  # the planes with letters and tags
            c = chr(code)
            if unicodedata.category(c) == "Cf":
                direct[c] = ""
                continue
            if m := unicodedata.combining(c):
                self.mark[c] = m
            d = unicodedata.decomposition(c).split()
            if not d:
                continue
            if d[0] in ("<wide>", "<narrow>"):
                direct[c] = "".join(chr(int(x, 16)) for x in d[1:])
                self.widths.setdefault(direct[c], []).append(c)
            elif d[0][0] != "<":
                direct[c] = "".join(chr(int(x, 16)) for x in d)
                if len(d) == 2 and unicodedata.normalize("NFC", c) == c:
                    self.pair[direct[c][0], direct[c][1]] = c
        for lead, vowel in product(range(19), range(21)):  # Hangul syllables follow a rule
            two = chr(0xAC00 + (lead * 21 + vowel) * 28)
            self.pair[chr(0x1100 + lead), chr(0x1161 + vowel)] = two
            direct[two] = chr(0x1100 + lead) + chr(0x1161 + vowel)
            for tail in range(1, 28):
                three = chr(ord(two) + tail)
                self.pair[two, chr(0x11A7 + tail)] = three
                direct[three] = two + chr(0x11A7 + tail)

        def whole(c: str) -> str:
            return "".join(map(whole, direct[c])) if c in direct else c

        self.apart = {c: whole(c) for c in direct}

    def ordered(self, cluster: str, latin: bool) -> str:
        """The output for any cluster by the tables: taken apart, look-alikes replaced, marks in order, put together."""
        apart = "".join([self.apart.get(c, c) for c in cluster])
        if latin:
            apart = "".join([self.look.get(c, c) for c in apart])
        mark, held, run = self.mark, [], []
        for c in apart:  # marks of different classes have one order, those of the same class keep theirs
            if c in mark:
                run.append(c)
            else:
                held += sorted(run, key=mark.__getitem__)
                run = []
                held.append(c)
        held += sorted(run, key=mark.__getitem__)
        out, base, last = [], -1, 0
        for c in held:
            m = mark.get(c, 0)
            free = base >= 0 and (last < m if last else base == len(out) - 1)
            if free and (one := self.pair.get((out[base], c))):
                out[base] = one
                continue
            if not m:
                base, last = len(out), 0
            else:
                last = m
            out.append(c)
        return "".join(out)

    def _spellings(self, c: str) -> set[str]:
        """All ways of writing a character that Unicode holds equivalent."""
        forms, new = set(), [self.apart[c]]
        while new:
            form = new.pop()
            if form in forms:
                continue
            forms.add(form)
            for i in range(len(form) - 1):
                x, y = form[i], form[i + 1]
                if self.mark.get(x) and self.mark.get(y) and self.mark[x] != self.mark[y]:
                    new.append(form[:i] + y + x + form[i + 2 :])
                if (x, y) in self.pair:
                    new.append(form[:i] + self.pair[x, y] + form[i + 2 :])
        return forms

    def _compiled(self, latin: bool) -> dict[str, str]:
        """The table of one context, every entry checked: no cluster has two outputs, and no output changes again."""
        alike: dict[str, list[str]] = {}
        if latin:
            for odd, plain in self.look.items():
                alike.setdefault(plain, []).append(odd)
        variants = lambda x: [x, *self.widths.get(x, ()), *alike.get(x, ())]
        table: dict[str, str] = {}

        def enter(cluster: str, out: str) -> None:
            if table.setdefault(cluster, out) != out:
                raise ValueError(f"{cluster!r} has two outputs")

        syllable = lambda c: "\uac00" <= c <= "\ud7a3"
        for c in [*self.apart, *(self.look if latin else ())]:
            if not syllable(c):
                enter(c, self.ordered(c, latin))
        composed = {c for c in self.pair.values() if not syllable(c)}
        for c in composed:
            if latin and self.apart[c][0] in self.look:
                continue  # it isn't an output in a word with Latin letters; its spellings come with the one it becomes
            for form in self._spellings(c):
                for spelling in product(*map(variants, form)):
                    enter("".join(spelling), c)
        if latin:
            for c in composed:
                if self.apart[c][0] in self.look:
                    for form in self._spellings(c):
                        enter(form, self.ordered(c, True))
        for cluster, out in table.items():
            if self.ordered(cluster, latin) != out or self.ordered(out, latin) != out:
                raise ValueError(f"the output for {cluster!r} isn't settled")
        for (x, y), c in self.pair.items():
            if syllable(c):
                enter(x + y, c)
                if syllable(x):
                    enter(self.apart[x] + y, c)
        return table

    def token(self, token: str) -> str:
        """A text without white space; most have nothing that could change."""
        if not self.active.search(token) and not (self.odd.search(token) and _LATIN.search(token)):
            return token
        parts, word, latin = [], [], False
        for cluster in _CLUSTER.findall(token):
            if _WORD.match(cluster):
                word.append(cluster)
                latin = latin or _LATIN.search(cluster) is not None
            else:
                table = self.latin if latin else self.plain
                parts += [table[c] for c in word]
                parts.append(self.plain[cluster])
                word, latin = [], False
        table = self.latin if latin else self.plain
        parts += [table[c] for c in word]
        return "".join(parts)

    def __call__(self, text: str) -> str:
        if text.isascii():  # nothing but white space can change
            return " ".join(text.split())
        runs = self.runs
        out = [runs[r] for r in _SCAN.findall(text)]
        if "" in out:  # what is dropped doesn't part white space
            out = [x for x in out if x]
            out = [x for x, y in zip(out, ["", *out]) if x != " " or y != " "]
        return "".join(out).strip(" ")


@cache
def transducer() -> Transducer:
    """The transducer of this process."""
    return Transducer()


def consistent(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """``key`` and ``text``, the text in its one consistent form.

    Format characters (Cf) are dropped; full-width and half-width forms become ordinary; the text is
    composed (NFC); in a word with a Latin letter, Cyrillic and Greek letters printed like a Latin one
    become it; a run of white space becomes one space, at the ends none. All else stays. Null stays
    null, a blank text becomes empty. Other columns are left out.
    """

    def map_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = transducer()
        for batch in batches:
            texts = [None if t is None else form(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    taken = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return taken.mapInArrow(map_texts, taken.schema).select(F.col("key").alias(key), F.col("text").alias(text))


def look_classes(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """``key``, ``form``, ``raw``: digests of the consistent form and of the text itself.

    Texts look the same if their ``form`` is equal, and are the same if ``raw`` is. Null and blank
    texts and null keys are left out; a row that comes twice comes back once.
    """

    def map_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = transducer()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            digests = [[hashlib.md5(x.encode(), usedforsecurity=False).digest() for x in (t, form(t))] for t in texts]
            full = pa.array([not (not t or t.isspace()) for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([d[1] for d in digests], pa.binary()), pa.array([d[0] for d in digests], pa.binary())], ["key", "form", "raw"]).filter(full)

    taken = df.select(F.col(key).alias("key"), F.col(text).alias("text")).dropna()
    schema = taken.select("key", F.lit(b"").alias("form"), F.lit(b"").alias("raw")).schema
    return taken.mapInArrow(map_texts, schema).distinct()


def look_alike_groups(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """The texts that look the same in groups: ``key``, ``form``, ``raw``, ``texts`` and ``members``.

    A row for each key whose text looks like a different one: digests of the consistent form (the group) and of the text, and how many
    different texts and how many keys the group has. As many rows as keys, where pairs may be as many as their square.
    """
    classes = written(look_classes(df, key=key, text=text), "forms")
    counted = classes.groupBy("form", "raw").agg(F.count(F.lit(1)).alias("n")).groupBy("form").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("members"))
    return join_spread(classes, counted.filter("texts > 1"), ["form"], ["key"]).select(F.col("key").alias(key), F.hex("form").alias("form"), F.hex("raw").alias("raw"), "texts", "members")


def look_alike_pairs(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """``a`` < ``b``: keys of every two texts that look the same and differ.

    Only digests are shuffled. Forms that one text alone has, however often it is repeated, are
    dropped before pairs are made; the rows of a form that very many texts have are spread.
    """
    classes = written(look_classes(df, key=key, text=text), "forms")
    varied = classes.groupBy("form").agg(F.min("raw").alias("x"), F.max("raw").alias("y")).filter("x <> y").select("form")
    members = written(classes.join(varied, "form", "left_semi"), "members")
    hot = hot_keys(members, ["form"])
    left = spread(members.withColumnsRenamed({"key": "a", "raw": "raw_a"}), hot, ["form"], ["a"])
    right = repeat(members.withColumnsRenamed({"key": "b", "raw": "raw_b"}), hot, ["form"])
    return left.join(right, ["form", "__salt"]).filter("a < b and raw_a <> raw_b").select("a", "b")
