"""One consistent form for texts that look the same (p3).

A text is cut into tokens of letters that are neither Hangul nor Han. Each letter of a token has a script set: the scripts it is written in (Unicode
Script_Extensions), resolved by those that have a letter looking like it. The sets are intersected over the token. A token whose letters share no script
as they are is mixed, and is spelt in a script of the resolved intersection: Latin where that can hold the whole word, else the one that most of its letters come
from. A token of one other script that Latin can hold as well is a whole-script confusable and is spelt in Latin. Words of another script with a
letter that has no Latin twin keep their script. Letters that are only roughly alike (small capitals, digits) count where nothing else resolves the token. Then the
remaining forms are normalised: full- and half-width forms, mathematical letters, loose conjoining jamo and combining marks that compose, characters that
show nothing, unusual spaces.

Which letters look alike comes from the public confusables data (Unicode UTS 39) of the JVM's ICU, by :func:`public_twins`, and from the fixed values below.

Not touched: compatibility jamo as in chat, unit signs, circled numbers, fractions, the ellipsis, Han characters, whatever emoji
consist of, composed accented letters, line ends and tabs.

Defined results: null stays null and is no case, the empty text stays empty; a value is a case exactly if normalising changes it; texts of
any length are taken whole; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Letters of other scripts that look like Latin ones, and those.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХЗҮԌҺԚԜаеѕіјорсухһԁԛԝѵүӏкгв", "ABESIJKMHOPCTYX3YGHQWaesijopcyxhdqwvylkrB"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαικνορυχγϲ", "ABEZHIKMNOPTYXCjaikvopuxyc"))
ARMENIAN = dict(zip("ՕՍՏԼօոսհցզյքԱ", "OUSLonuhgqjfU"))
CHEROKEE = dict(zip("ᎪᎠᎡᎢᎥᎫᎬᎳᎷᎻᎽᏀᏂᏃᏎᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ", "ADRTiJEWMHYGhZ4bRWSVSLCPKdB"))
#: Twins that pass for a Latin letter only beside real ones: a digit, or a small capital.
BESIDE_LATIN = frozenset("Згвк")
#: Latin letters that pass for a Cyrillic one only beside real ones.
BESIDE_CYRILLIC = {"k": "к", "r": "г", "t": "т", "m": "м"}
TWINS = {other: latin for table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE) for other, latin in table.items() if latin.isalpha()}
#: Scripts whose letters are taken for Latin ones; all others are told apart from them, but never respelt.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Armenian", "Cherokee", "Coptic", "Lisu")
_IN_SCRIPT = {name: regex.compile(rf"\p{{scx={name}}}") for name in SCRIPTS}
_PHONETIC = range(0x250, 0x2B0)
#: JVM side: a text of nothing but these characters is no case and needs no Python.
PLAIN = r"[^\t\n\r\x20-\x7E\x{AC00}-\x{D7A3}\x{3131}-\x{3163}\x{3165}-\x{318E}\x{2026}\x{4E00}-\x{9FFF}]"

_JAMO_RUN = re.compile("[가-힣]?[ᄀ-ᇿꥠ-ꥼힰ-ퟻ]+")
_PIECES = re.compile("[^\\W\\d_][̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯]+")
_WIDE = re.compile("[！-ﾟﾡ-ￜ￠-￦￨-￮]+")
_MATHEMATICAL = re.compile("[\U0001d400-\U0001d7ff]+")
_SPACES = re.compile("[   -     　]")
_TOKEN = re.compile("(?:[^\\W\\d_가-힣ᄀ-ᇿ㄰-㆏㐀-鿿豈-﫿぀-ヿ][̀-ͯ]*)+")
_LOOK = re.compile("[^\t\n\r\x20-\x7e가-힣ㄱ-ㅣㅥ-ㆎ…一-鿿]")
#: Emoji: presentation sequences, keycaps, flags, tag sequences and sequences joined by U+200D.
_PICTURE = "[©®‼⁉™ℹ←-⇿⌀-⏿Ⓜ■-➿⤀-⥿⬀-⯿〰〽㊗㊙\U0001f000-\U0001f1e5\U0001f200-\U0001faff]"
_ELEMENT = f"(?:{_PICTURE}[︎️]?[\U0001f3fb-\U0001f3ff]?[\U000e0020-\U000e007f]*|[0-9#*]️?⃣|[\U0001f1e6-\U0001f1ff]{{2}})"
_EMOJI = re.compile(f"{_ELEMENT}(?:‍{_ELEMENT})*")
_FILLERS = frozenset("͏ᅟᅠ឴឵᠋᠌᠍᠎᠏⠀ㅤﾠ")
_COMPATIBILITY_JAMO: dict[str, str] = {}
for _code in range(0x3131, 0x318F):
    _one = unicodedata.normalize("NFKC", chr(_code))
    if len(_one) == 1 and _code != 0x3164:
        _COMPATIBILITY_JAMO.setdefault(_one, chr(_code))
for _final in range(0x11A8, 0x11C3):  # a final has the letter of its initial or cluster
    _name = unicodedata.name(chr(_final)).replace("JONGSEONG", "LETTER")
    try:
        _COMPATIBILITY_JAMO.setdefault(chr(_final), unicodedata.lookup(_name))
    except KeyError:
        pass


def _invisible(ch: str) -> bool:
    if ch in "\t\n\r\x0b\x0c\x85":
        return False
    return ch in _FILLERS or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef" or unicodedata.category(ch) in ("Cf", "Cc")


def _width(match: re.Match) -> str:
    return unicodedata.normalize("NFC", "".join(_COMPATIBILITY_JAMO.get(n, n) for n in (unicodedata.normalize("NFKC", ch) for ch in match.group())))


def _compose(match: re.Match) -> str:
    whole = unicodedata.normalize("NFC", match.group())
    return "".join(_COMPATIBILITY_JAMO.get(ch, ch) for ch in whole)


@lru_cache(maxsize=65_536)
def scripts(letter: str) -> frozenset[str]:
    """The scripts of SCRIPTS a letter is written in, or one that stands for all others."""
    return frozenset(name for name, pattern in _IN_SCRIPT.items() if pattern.match(letter)) or frozenset(("other",))


class Spelling:
    """How letters of several scripts stand for one another, by a table of letters and the Latin ones they look like."""

    def __init__(self, twins: dict[str, str]) -> None:
        self.twins = {other: latin for other, latin in twins.items() if scripts(other) <= set(SCRIPTS[1:])}
        self.phonetic = {other: latin for other, latin in twins.items() if ord(other) in _PHONETIC}
        self.letters: dict[str, dict[str, str]] = {name: {} for name in SCRIPTS[1:]}  # script -> Latin letter -> its twin there
        for other, latin in self.twins.items():
            if other not in BESIDE_LATIN:
                for name in scripts(other):
                    self.letters[name].setdefault(latin, other)

    def resolved(self, letter: str, roughly: bool = False) -> frozenset[str]:
        """The scripts that have this letter or one that looks like it."""
        own = scripts(letter)
        latin = letter if "Latin" in own else self.twins.get(letter)
        if latin is None or letter in BESIDE_LATIN and not roughly:
            return own
        found = own | {"Latin"} | {name for name, known in self.letters.items() if latin in known}
        return found | {"Cyrillic"} if roughly and latin in BESIDE_CYRILLIC else found

    def _written(self, ch: str, script: str) -> str:
        parts = unicodedata.normalize("NFD", ch)
        base = parts[0]
        if script in scripts(base) or unicodedata.combining(base):
            return ch
        latin = base if "Latin" in scripts(base) else self.twins.get(base)
        twin = latin if script == "Latin" else self.letters[script].get(latin) or (BESIDE_CYRILLIC.get(latin) if script == "Cyrillic" else None)
        return unicodedata.normalize("NFC", twin + parts[1:]) if twin else ch

    def token(self, token: str) -> str:
        """The token in the script that its letters resolve to; as it is if nothing in it stands for something else."""
        if token.isascii():
            return token
        letters = [unicodedata.normalize("NFD", ch)[0] for ch in token if not unicodedata.combining(ch)]
        if self.phonetic and any(x in self.phonetic for x in letters) and sum(x.isascii() for x in letters) >= max(2, len(letters) / 2) and all(x.isascii() or x in self.phonetic for x in letters):
            return "".join(self.phonetic.get(ch, ch) for ch in token)
        if not any(x in self.twins for x in letters):
            return token
        shared = frozenset.intersection(*[scripts(x) for x in letters])
        common = frozenset.intersection(*[self.resolved(x) for x in letters])
        if shared:  # of one script: a whole-script confusable, or a word of its own
            return self._spelt(token, "Latin") if "Latin" in common else token
        if not common:
            common = frozenset.intersection(*[self.resolved(x, roughly=True) for x in letters])
        if not common:  # no script holds the whole word: what can pass for Latin beside Latin letters does
            return self._spelt(token, "Latin") if any("Latin" in scripts(x) for x in letters) else token
        if "Latin" in common:
            return self._spelt(token, "Latin")
        most = max(sorted(common), key=lambda name: sum(name in scripts(x) for x in letters))
        return self._spelt(token, most) if most in self.letters else token

    def _spelt(self, token: str, script: str) -> str:
        return "".join(self._written(ch, script) for ch in token)

    def normalize(self, text: str) -> str:
        """The consistent form of a text."""
        if not _LOOK.search(text):
            return text
        out, at = [], 0
        for emoji in _EMOJI.finditer(text):
            out += [self._part(text[at : emoji.start()]), emoji.group()]
            at = emoji.end()
        out.append(self._part(text[at:]))
        return "".join(out)

    def _part(self, part: str) -> str:
        if not _LOOK.search(part):
            return part
        part = "".join(ch for ch in part if ch.isascii() and ch >= " " or not _invisible(ch))
        part = _SPACES.sub(" ", part)
        part = _WIDE.sub(_width, part)
        part = _MATHEMATICAL.sub(lambda m: unicodedata.normalize("NFKC", m.group()), part)
        part = _JAMO_RUN.sub(_compose, part)
        part = _TOKEN.sub(lambda m: self.token(m.group()), part)
        return _PIECES.sub(lambda m: unicodedata.normalize("NFC", m.group()), part)


#: Letters as the fixed values have them, without a JVM.
FIXED = Spelling(TWINS)


def public_twins(spark: SparkSession) -> dict[str, str]:
    """Letters and the Latin ones that they look like: the public confusables data of the JVM's ICU, for letters of SCRIPTS and phonetic letters, and the fixed
    values, which hold where both name a letter. A few hundred entries, whatever the data."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    latin = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1))]
    others = [ch for ch in map(chr, range(0x80, 0x1_1000)) if unicodedata.category(ch) in ("Lu", "Ll", "Lo", "Lt") and (ord(ch) in _PHONETIC or scripts(ch) <= set(SCRIPTS[1:]))]
    looks = dict(zip([*latin, *others], checker.getSkeleton("\n".join([*latin, *others])).split("\n")))
    by_look: dict[str, list[str]] = {}
    for x in latin:
        by_look.setdefault(looks[x], []).append(x)
    found = {}
    for other in others:
        if looks[other] in by_look:
            same = by_look[looks[other]]  # the letter of the same case, if there are two
            found[other] = next((x for x in same if x.isupper() != other.islower()), same[0])
    return {**found, **TWINS}


def normalize(text: str) -> str:
    """The consistent form of a text by the fixed values."""
    return FIXED.normalize(text)


def normalized(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep``, ``text`` and ``form``, its consistent form."""
    twins = public_twins(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = Spelling(twins)
        for batch in batches:
            forms = [t if t is None else spelling.normalize(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=[*batch.schema.names, "form"])

    schema = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keep)
    return df.select(*[F.col(k) for k in keep], F.col(text)).mapInArrow(run, f"{schema}`{text}` STRING, form STRING")


def suspicious(value: Column) -> Column:
    """Whether a value holds any character that might be a stand-in; all others are in their consistent form already."""
    return value.rlike(PLAIN)


def stand_ins(values: DataFrame, text: str, *keep: str) -> DataFrame:
    """The columns ``keep`` of values that are cases: their form differs. Most values are passed over in the JVM."""
    changed = normalized(values.where(suspicious(F.col(text))), text, *keep)
    return changed.where(F.col(text) != F.col("form")).select(*keep)


def record_values(records: DataFrame) -> DataFrame:
    """Every text of a corpus record: ``rec_no``, ``field``, ``err_pos`` (-1 for the sentences), ``value``."""
    sentence = [F.struct(F.lit(c).alias("field"), F.lit(-1).cast("bigint").alias("err_pos"), F.col(c).alias("value")) for c in ("err_sentence", "cor_sentence")]
    errors = F.transform(F.coalesce(F.col("errors.err_text"), F.array().cast("array<string>")), lambda e, i: F.struct(F.lit("err_text").alias("field"), i.cast("bigint").alias("err_pos"), e.alias("value")))
    return records.select("rec_no", F.explode(F.concat(F.array(*sentence), errors)).alias("v")).select("rec_no", "v.*")
