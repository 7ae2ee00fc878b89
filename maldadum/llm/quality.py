"""Per-document text quality statistics and the kind of each document: prose, list, table or junk (p10).

Lines are told apart first: table rows share a separator and a number of cells with their neighbours; junk lines are symbol runs,
encoded or garbled characters, markup, addresses, loose jamo or syllables that no usual text has; list items are short, marked or not,
and end in no predicate; the rest is prose. Repetition is measured over the whole text: shares of duplicate lines and paragraphs and
the characters covered by the word n-gram that covers most of them. A document is what most of its characters are, unless figures of the whole
text say otherwise: repetition, a text of symbols or without blanks is junk, and short lines that end in punctuation and hold common words are prose.

Defined results: null, empty and blank texts have zero counts, null shares and no kind; texts are taken whole; repeated ids are
documents of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# What separates cells, marks items and ends Korean predicates and clauses.
SEPARATORS = ("\t", "|", ";", ",", "   ")
COMMON_WORDS = frozenset((
    # Korean connectives, adverbs, nouns of time and dependent nouns
    "그리고 그런데 그러나 그래서 하지만 그래도 그러면 따라서 또는 또 및 사실 물론 결국 아무튼 게다가 오늘 어제 그제 내일 지금 아침 저녁에 이미 아직 매우 아주 정말 너무 다시 더 가장 잘 안 못 것 수 등 때 중 이 그 저 우리 나는 제가 "
    # English
    "the a an of and to in is it that for on with as was at by be this are from or have not but they you he she we his her their "
    # German
    "der die das und ist nicht ein eine zu den von mit auf für sich im dem auch es an als "
    # French
    "le la les et des est une du dans que qui pour pas au par sur il elle "
    # Spanish
    "el los las y en que un por con para del se no su al lo como").split())
_MARK = re.compile(r"\s*(?:>\s*)?(?:[-*+•·∙‣□■☐☑☒▶▷▪▫◦○●◆◇★☆※✓✔]|\[[ xXvV✓]?\]|\(?\d{1,3}[.):]|\(?[가-하a-zA-Z][.)]|[①-⑳])\s*")
_PREDICATE = re.compile(r"(?:[다요까죠네냐라자군지음임함됨]|니다|세요|거든|는데|어|아|해|게|래|데|고|며|나|만|서|면|니)[\"'’”)\]]*[.?!~…ㅋㅎㅠㅜ^;]*$")
_ENDED = re.compile(r"[.?!~…]+[\"'’”)\]]*$")
_SENTENCE = re.compile(r"[가-힣](?:다|요|까|죠|네|지|냐|자|음|댜|오|애)[.?!~…]*(?:[\"'’”)\s]|$)")
_CLAUSE = re.compile(r"(?:[가-힣](?:고|며|으나|지만|는데|으니까|니까|더니|기에|으면|면서|어서|아서|해서|려고)|에서|에게|으로|[가-힣][은는이가을를])[,.?!~…]*(?=\s|$)")
_URL = re.compile(r"(?:https?://|www\.)\S+|\S+@\S+\.\S+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>?|&[a-z]+;")
_CODE = re.compile(r"[A-Za-z0-9+/=_-]{16,}")
_HANGUL = re.compile(r"[가-힣]")
_JAMO = re.compile(r"[ㄱ-ㅎㅏ-ㅣ]")
_CHAT = re.compile(r"(?:([ㅋㅎㅠㅜㅇㄷㄱㄴ])\1*|ㅇㅋ|ㄱㅅ|ㅊㅋ|ㅅㄱ|ㅇㅈ|ㅁㄹ|ㅈㅅ|ㄹㅇ)[.!?~]*")
_GARBLED = re.compile("[\u0080-¿À-ſˆ˜‘-›€�]")
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
#: Scripts that are written without blanks, or often so.
_UNSPACED = re.compile("[가-힣぀-ヿ㐀-鿿ก-๛ກ-ໟ]")
_SYMBOL = re.compile(r"[^\w\s]|_")
#: Syllables outside the 2,350 of the KS X 1001 set, which the codec writes in pieces.
_UNUSUAL = re.compile("[" + "".join(ch for ch in map(chr, range(0xAC00, 0xD7A4)) if len(ch.encode("euc_kr")) != 2) + "]")


def _junk(line: str) -> bool:
    solid = "".join(line.split())
    n = len(solid)
    if "<" in line or "&" in line:
        rest = _TAG.sub(" ", line)
        if len(rest.strip()) < 0.6 * len(line.strip()):
            return True
    if ("://" in line or "www." in line or "@" in line) and sum(len(m.group()) for m in _URL.finditer(line)) > 0.5 * n:
        return True
    if n >= 4 and len(_SYMBOL.findall(solid)) > 0.6 * n:
        return True
    if len(_GARBLED.findall(solid)) > 0.3 * n:
        return True
    coded = sum(len(m.group()) for m in _CODE.finditer(line) if re.search(r"[A-Z]", m.group()) and re.search(r"[a-z]", m.group()))
    if coded > 0.5 * n:
        return True
    if _JAMO.search(line) and sum(len(w) for w in line.split() if not _CHAT.fullmatch(w) and len(_JAMO.findall(w)) > 0.6 * len(w)) > 0.5 * n:
        return True
    unusual = len(_UNUSUAL.findall(solid))
    return unusual > 0 and (hangul := len(_HANGUL.findall(solid))) >= 4 and unusual > 0.25 * hangul


def _item(text: str) -> bool:
    """A short phrase without a predicate."""
    words = text.split()
    if len(words) > 5 or len(text) > 40:
        return False
    if not words:
        return True
    if _ENDED.search(text) and len(words) > 1:
        return False
    if text.rstrip(" :-").endswith("하기") or words[-1][-1:].isdigit():
        return True
    return len(words) <= 3 or not (_SENTENCE.search(text) or _CLAUSE.search(text))


def _cells(line: str, separator: str) -> list[str]:
    line = line.strip(" ") if separator != "   " else line.strip()
    if separator == "|":
        line = line.strip("|")
    return re.split(r" {2,}", line) if separator == "   " else line.split(separator)


def _table_rows(lines: list[str]) -> list[bool]:
    """Which lines have at least two cells, as many as most lines with that separator, and a neighbour like them."""
    rows = [False] * len(lines)
    for separator in SEPARATORS:
        if sum(separator in x for x in lines) < 2:
            continue
        cut = [_cells(x, separator) for x in lines]
        widths = [len(c) if len(c) > 1 and sum(map(len, c)) / len(c) <= 15 and max(len(x.split()) for x in c) <= 5 else 0 for c in cut]
        usual = Counter(w for w in widths if w)
        if not usual:
            continue
        width, n = usual.most_common(1)[0]
        if n < 2 or separator == "," and width < 3 and n < 3:
            continue
        if separator == "," and sum(", " in x for x in lines) > len(lines) / 2:
            continue
        near = 1 if separator == "   " else 0
        for i, w in enumerate(widths):
            if w and (w == width or abs(w - width) <= near):
                rows[i] = True
    return rows


def _enumerated(line: str) -> bool:
    """Many short items in a line, one after the other; nouns may end as predicates do, so that half of the items are enough to be none."""
    for separator in (", ", " / ", "/", " · ", "·", "; ", " | ", ",", "、"):
        items = line.split(separator)
        if len(items) >= 5:
            short = [x for x in items if len(x) <= 20 and len(x.split()) <= 3 or x.strip().endswith("하기")]
            if len(short) >= 0.8 * len(items) and sum(not _SENTENCE.search(x.strip() + " ") for x in short) >= 0.5 * len(items):
                return True
    return False


def _dominant(words: list[str], solid: int) -> float:
    """Share of the characters that the n-gram covering most of them covers, n from 1 to 4, 0 if none repeats. Characters under several places of it count once."""
    times = Counter(words)
    best = max((n * len(w) for w, n in times.items() if n > 1), default=0)
    if best:
        # an n-gram repeats only where all of its words do
        again = [times[w] > 1 for w in words]
        starts = [i for i, more in enumerate(again) if more]
        for n in (2, 3, 4):
            starts = [i for i in starts if i + n <= len(words) and again[i + n - 1]]
            places = [tuple(words[i : i + n]) for i in starts]
            # at most this many characters, if no two places overlap; the largest first
            most = sorted(((t * sum(map(len, g)), g) for g, t in Counter(places).items() if t > 1), reverse=True)
            for bound, gram in most:
                if bound <= best:
                    break
                covered, end = 0, 0
                for i, g in zip(starts, places):
                    if g == gram:
                        covered += sum(map(len, words[max(i, end) : i + n]))
                        end = i + n
                best = max(best, covered)
    return best / solid


def statistics(text: str) -> dict:
    """Counts, shares and the kind of a text that is not blank."""
    lines = [x for x in _BREAK.split(text) if x.strip()]
    words = text.split()
    solid = sum(map(len, words))
    paragraphs = [p.strip() for p in re.split(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)", text) if p.strip()]
    out = {
        "n_words": len(words),
        "n_lines": len(lines),
        "mean_word_length": solid / len(words),
        "symbol_ratio": len(_SYMBOL.findall(text)) / solid,
        "punctuated_lines": sum(bool(_ENDED.search(x.rstrip())) for x in lines) / len(lines),
        "common_words": sum(w.strip(".,!?~…\"'()").lower() in COMMON_WORDS for w in words) / len(words),
        "duplicate_lines": 1 - len({x.strip() for x in lines}) / len(lines),
        "duplicate_paragraphs": 1 - len(set(paragraphs)) / len(paragraphs),
    }
    cover = _dominant(words, solid)
    out["dominant_ngram"] = cover
    table = _table_rows(lines)
    marked = [_MARK.match(x) for x in lines]
    kinds: Counter = Counter()
    prose_lines = 0
    for line, row, mark in zip(lines, table, marked):
        weight = len("".join(line.split()))
        body = line[mark.end() :] if mark else line
        if ("<" in line or "&" in line) and _TAG.search(line) and _junk(line):
            kinds["junk"] += weight
        elif row:
            kinds["table"] += weight
        elif _junk(line):
            kinds["junk"] += weight
        elif _enumerated(body):
            kinds["list"] += weight
        elif _item(body.strip()):
            kinds["list" if mark or len(lines) > 1 else "phrase"] += weight
        else:
            kinds["prose"] += weight
            prose_lines += 1
    total = sum(kinds.values())
    shares = {k: kinds[k] / total for k in ("prose", "list", "table", "junk")}
    best = max(("prose", "list", "table", "junk"), key=lambda k: shares[k])
    kind = best if best != "prose" and shares[best] > 0.5 else None
    repeated = len(lines) >= 6 and out["duplicate_lines"] > 0.6 or len(paragraphs) >= 6 and out["duplicate_paragraphs"] > 0.6
    if len(words) >= 6 and cover > 0.5:
        kind = "junk"
    elif repeated and shares["prose"] < 0.5 and kind != "table":
        kind = "junk"
    elif kind is None and (out["symbol_ratio"] > 0.8 or out["mean_word_length"] > 60 and not out["common_words"] and not _UNSPACED.search(text)):
        kind = "junk"  # hardly a letter, or hardly a blank where words are written apart
    elif kind == "list" and out["punctuated_lines"] >= 0.8 and out["common_words"] >= 0.2:
        kind = None  # running sentences in short lines
    elif kind == "list" and sum(map(bool, marked)) + shares["list"] * len(lines) < 3 and not any(_enumerated(x) for x in lines):
        kind = None  # one or two short lines are no enumeration
    out |= {f"{k}_share": v for k, v in shares.items()} | {"doc_kind": kind}
    return out


COUNTS = ("n_words", "n_lines")
SHARES = ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "duplicate_lines", "duplicate_paragraphs", "dominant_ngram", "prose_share", "list_share", "table_share", "junk_share")


def document_statistics(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: ``key``, the counts, the shares and ``doc_kind`` ('list', 'table', 'junk', or null for prose and blank texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) if t and not t.isspace() else dict.fromkeys(COUNTS, 0) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[c] for r in rows], pa.int64()) for c in COUNTS]
            columns += [pa.array([r.get(c) for r in rows], pa.float64()) for c in SHARES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array([r.get("doc_kind") for r in rows], pa.string())], names=[key, *COUNTS, *SHARES, "doc_kind"])

    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, " + "".join(f"{c} BIGINT, " for c in COUNTS) + "".join(f"{c} DOUBLE, " for c in SHARES) + "doc_kind STRING"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
