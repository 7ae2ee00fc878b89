"""Closed vocabularies and fixed rule data."""

from __future__ import annotations

# Particles that a context term loses, in the order in which they are tried.
PARTICLES = (
    "으로는", "에게서", "한테서", "이라도", "처럼은", "으로", "에게", "한테", "에서", "부터", "까지", "처럼", "보다", "이랑", "랑",
    "이나", "나", "은", "는", "이", "가", "을", "를", "에", "의", "와", "과", "도", "만", "로",
)
#: The mining side knows three fewer.
MINING_PARTICLES = tuple(p for p in PARTICLES if p not in ("처럼은", "랑", "나"))

# Spans that no edit may touch. Kinds with their patterns (Java syntax), then literal names.
PROTECTED_PATTERNS = (
    ("URL", r"https?://[^\s]+"),
    ("EMAIL", r"(?i)(?U)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("PHONE", r"(?U)\b\d{2,4}-\d{3,4}-\d{4}\b"),
    ("HASHTAG", r"(?U)#[\w가-힣]+"),
    ("MENTION", r"(?U)@[\w가-힣._-]+"),
    ("NUMBER", r"(?U)\b\d+(?:[.,]\d+)?\b"),
)
ENTITIES = ("AirPods Pro 2", "RTX 4060", "ChatGPT")
USER_TERMS = ("온디바이스", "맞춤법", "교정기")

# Spelling fixes given by hand, (from, to, confidence).
MANUAL_FIXES = (
    ("되요", "돼요", 0.99), ("삿어요", "샀어요", 0.99), ("잇어요", "있어요", 0.96), ("바닦", "바닥", 0.99), ("안자", "앉아", 0.97),
    ("웬지", "왠지", 0.97), ("왠일", "웬일", 0.99), ("왠만", "웬만", 0.99), ("왠만한", "웬만한", 0.99), ("왠만하면", "웬만하면", 0.99),
    ("됀", "된", 0.99), ("됬", "됐", 0.99), ("됬다", "됐다", 0.99), ("됬고", "됐고", 0.99), ("됬네", "됐네", 0.99), ("됬어", "됐어", 0.99),
    ("됬는데", "됐는데", 0.99), ("됬으면", "됐으면", 0.99), ("좋겟다", "좋겠다", 0.99), ("좋겟네", "좋겠네", 0.99), ("좋겟어", "좋겠어", 0.99),
    ("모르겟다", "모르겠다", 0.99), ("모르겟지만", "모르겠지만", 0.99), ("모르겟습니다", "모르겠습니다", 0.99), ("해바", "해봐", 0.97),
)

# Phrases given by hand, (from, to, confidence).
MANUAL_PHRASES = (
    ("할수", "할 수", 0.99), ("될수", "될 수", 0.99), ("안돼", "안 돼", 0.99), ("마춰서", "맞춰서", 0.99),
    ("문제를 마 추고", "문제를 맞히고", 0.99), ("문제를 마추고", "문제를 맞히고", 0.99), ("정답을 마 추고", "정답을 맞히고", 0.99),
    ("정답을 마추고", "정답을 맞히고", 0.99), ("답을 마 추고", "답을 맞히고", 0.99), ("답을 마추고", "답을 맞히고", 0.99),
    ("시간을 마 추고", "시간을 맞추고", 0.99), ("시간을 마추고", "시간을 맞추고", 0.99), ("정답을 맞췄다", "정답을 맞혔다", 0.99),
    ("답을 맞췄다", "답을 맞혔다", 0.99), ("문제를 맞췄다", "문제를 맞혔다", 0.99), ("정답을 맞추었다", "정답을 맞혔다", 0.99),
    ("답을 맞추었다", "답을 맞혔다", 0.99), ("문제를 맞추었다", "문제를 맞혔다", 0.99), ("시간을 맞혀서", "시간을 맞춰서", 0.99),
    ("시간을 맞히고", "시간을 맞추고", 0.98), ("시간을 맞히다", "시간을 맞추다", 0.98), ("약을 먹고 많이 낮아졌다", "약을 먹고 많이 나아졌다", 0.98),
    ("몸이 많이 낮아졌다", "몸이 많이 나아졌다", 0.97), ("상태가 많이 낮아졌다", "상태가 많이 나아졌다", 0.97), ("병이 금방 낮는다", "병이 금방 낫는다", 0.98),
    ("감기가 금방 낮는다", "감기가 금방 낫는다", 0.98), ("상처가 금방 낮는다", "상처가 금방 낫는다", 0.98), ("안자 있었다", "앉아 있었다", 0.98),
    ("안자있었다", "앉아 있었다", 0.98), ("않 와", "안 와", 0.98), ("않 와서", "안 와서", 0.99), ("못해", "못 해", 0.97), ("해 바", "해봐", 0.97),
)

# Replacements given by hand, (from, to, origin, score), and stems often mistaken for another, (wrong, right, score).
OPEN_REPLACEMENTS = (
    ("낫다", "낳다", "CONFUSION_SET", 0.94), ("낫다", "놓다", "MORPH", 0.41),
    ("안되", "안 돼", "CONFUSION_SET", 0.88), ("안되", "안돼", "MORPH", 0.35),
)
STEM_CONFUSIONS = (("낫", "낳", 0.82),)
# Endings often misspelt, (form, tag, right form, score).
MORPHEME_CONFUSIONS = (("겟", "EP", "겠", 0.93), ("엇", "EP", "었", 0.91), ("앗", "EP", "았", 0.91))

# Lemmas too broad to be mined as edges, and pairs allowed all the same.
BROAD_LEMMAS = ("하다", "되다", "가다", "나다", "나오다", "알다", "있다")
BROAD_ALLOWED = (("잇다", "있다"), ("허다", "하다"), ("돼다", "되다"))
PREDICATE_TAGS = ("VV", "VA", "VX")

# Weight of a candidate's origin, in the order in which origins are tried; any other origin weighs 0.25.
SOURCE_PRIOR = {
    "CONFUSION_SET": 1.0, "DATA_CONFUSION": 0.99, "PHRASE_MEMORY": 0.99, "PHRASE_MEMORY_FUZZY": 0.95, "MORPHEME_CONFUSION": 0.98, "LEMMA_DATA_CONFUSION": 0.97,
    "FAMILY_SEED": 0.97, "AUTO_FAMILY_SEED": 0.96, "INFLECTION_RULE": 0.95, "LEMMA_CONFUSION": 0.95, "FAMILY_SURFACE_EXAMPLE": 0.95, "MORPH": 0.9,
    "JAMO_FALLBACK": 0.72, "SURFACE_JAMO_FALLBACK": 0.76, "JAMO": 0.7, "MLM_TOPK": 0.35,
}
OTHER_PRIOR = 0.25
# Origins that a similarity of .48 can be enough for.
CURATED_SOURCES = (
    "CONFUSION_SET", "MORPH", "LEMMA_CONFUSION", "MORPHEME_CONFUSION", "COMMON_SURFACE_PATTERN", "COMMON_PHRASE_PATTERN", "DATA_CONFUSION", "LEMMA_DATA_CONFUSION",
    "FAMILY_SEED", "AUTO_FAMILY_SEED", "FAMILY_SURFACE_EXAMPLE", "PHRASE_MEMORY", "PHRASE_MEMORY_FUZZY", "INFLECTION_RULE", "SURFACE_JAMO_FALLBACK",
)

#: Origins of edges between lemmas, whose candidates know the lemmas of their family.
FAMILY_SOURCES = ("LEMMA_DATA_CONFUSION", "FAMILY_SEED", "AUTO_FAMILY_SEED", "FAMILY_SURFACE_EXAMPLE", "INFLECTION_RULE")

# What tokens are.
TOKEN = r"[가-힣A-Za-z0-9]+|[^\s]"
#: The same for the JVM, whose classes are of ASCII unless told.
JVM_TOKEN = "(?U)" + TOKEN
WORD = r"[가-힣A-Za-z0-9]+"
CLAUSE_ENDS = "\n.?!,;"
LABEL_PRIORITY = {"KEEP": 0, "PUNCT_FIX": 1, "SPACE_FIX": 2, "OPEN_REPLACE": 3}
