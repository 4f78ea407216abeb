"""Regular-expression classes and word tables.

The classes are spelled with explicit code points because ``\\w`` and ``\\s`` are
ASCII-only in Java unless a flag is set, and the text here is not ASCII-only.
"""

# Unicode whitespace, its complement, and word characters.
WS = (
    r"[\t-\r \x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The characters of WS, for trimming.
WS_CHARS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
# Listed as ranges, printable ASCII first: a negated union is twice as slow in Java.
NS = (
    r"[!-~[[^\x00-\x7f]&&[^\x85\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]\x00-\x08\x0e-\x1b\x7f]"
)
WORD = r"[\p{L}\p{N}_]"
# WS and WORD for Java only: the same characters, but one that is ASCII is decided by the first
# parts. The clean-up steps take about half the time with them; tokens are no faster.
JAVA_WS = (
    r"[\t\n\x0b\f\r \x1c\x1d\x1e\x1f[[^\x00-\x7f]&&[\x85\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]"
)
JAVA_WORD = r"[a-zA-Z0-9_[[^\x00-\x7f]&&[\p{L}\p{N}]]]"
# Runs of NS and of WORD for Java only. What a run mostly consists of is one cheap class, all other
# characters are a second one: two to three times as fast as NS+ and WORD+. The groups are
# possessive, so a long run needs no stack.
JAVA_NS_RUN = (
    r"(?:[^\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\x{100}-\x{10ffff}]++"
    r"|[[\x{100}-\x{10ffff}]&&[^\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]++)++"
)
# Characters listed one by one are a single lookup in Java, ranges are one test each.
_ASCII_WORD = "".join(c for c in map(chr, range(128)) if c.isalnum() or c == "_")
_ASCII_MARK = "".join(f"\\x{c:02x}" for c in range(128) if chr(c) not in _ASCII_WORD and not chr(c).isspace())
JAVA_WORD_RUN = f"(?:[{_ASCII_WORD}]++" + r"|[[^\x00-\x7f]&&[\p{L}\p{N}]]++)++"
# One character that is neither in WORD nor in WS.
JAVA_MARK = (
    f"(?:[{_ASCII_MARK}]" + r"|[[^\x00-\x7f]&&[^\p{L}\p{N}\x85\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]])"
)
NOT_WORD = r"[^\p{L}\p{N}_]"

# --- fixed values -----------------------------------------------------------
# Clean-up steps for the spacing that generation models leave behind. Order
# matters; every step replaces all non-overlapping hits from left to right. The
# first entry is the character without which a step changes nothing.
TOKENIZATION_FIXES = [
    ("'", f"({WORD}){WS}+'{WS}+({WORD})", "$1'$2"),
    ("'", f"({WORD})'{WS}+({WORD})", "$1'$2"),
    ("'", f"({WORD}){WS}+'({WORD})", "$1'$2"),
    (".", rf"{WS}+\.", "."),
    (",", f"{WS}+,", ","),
    ("?", rf"{WS}+\?", "?"),
    ("!", f"{WS}+!", "!"),
    (";", f"{WS}+;", ";"),
    (":", f"({WORD}){WS}+:", "$1:"),
    ('"', f'"{WS}+({NS})', '" $1'),
    ('"', f'({NS}){WS}+"', '$1 "'),
    ("-", f"([a-zA-Z]){WS}+-{WS}+([a-zA-Z])", "$1-$2"),
]

# The same for Java. Taking the spaces before one mark makes no place for another, so neighbouring
# steps that do only that are one search for any of their marks.
_CLOSING = [mark for mark, pattern, _ in TOKENIZATION_FIXES if pattern in (f"{WS}+{mark}", rf"{WS}+\{mark}")]
JAVA_FIXES = []
for _mark, _pattern, _replacement in TOKENIZATION_FIXES:
    if _mark not in _CLOSING:
        _java = _pattern.replace(WS, JAVA_WS).replace(WORD, JAVA_WORD)
        JAVA_FIXES.append(([_mark], _java, _replacement))
    elif _mark == _CLOSING[0]:
        JAVA_FIXES.append((_CLOSING, f"{JAVA_WS}++([{''.join(_CLOSING)}])", "$1"))

# Emoji and pictographs. The block from 24C2 to 1F251 also covers CJK.
EMOJI = (
    r"[\x{200D}\x{2300}-\x{23FF}\x{24C2}-\x{1F251}\x{1F300}-\x{1F64F}"
    r"\x{1F680}-\x{1F7FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]+"
)
# The same without the letters and ideographs between 2C00 and 1F1E5.
STRICT_EMOJI = (
    r"[\x{200D}\x{2300}-\x{23FF}\x{24C2}-\x{2BEF}\x{FE0E}\x{FE0F}\x{1F1E6}-\x{1F1FF}"
    r"\x{1F300}-\x{1F64F}\x{1F680}-\x{1F7FF}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FAFF}]+"
)

ERROR_LABELS = {
    "NOUN:POSS": "Noun Possessive",
    "CONTR": "Contraction",
    "VERB:FORM": "Verb Form",
    "VERB:TENSE": "Verb Tense",
    "NOUN": "Noun Choice",
    "VERB": "Verb Choice",
    "ADJ": "Adjective",
    "ADV": "Adverb",
    "PREP": "Preposition",
    "DET": "Determiner / Article",
    "PART": "Particle / Phrasal Verb",
    "PUNCT": "Punctuation",
    "SPACE": "Whitespace",
    "PRON": "Pronoun",
    "CONJ": "Conjunction",
    "NUM": "Number",
    "SYM": "Symbol",
    "X": "Other Token",
    "OTHER": "Other / Uncategorized",
    "ORTH": "Orthography (Case / Space)",
    "WO": "Word Order",
    "SPELL": "Spelling",
    "MORPH": "Morphology / Derivation",
    "ADJ:FORM": "Adjective Form",
    "NOUN:NUM": "Noun Number",
    "VERB:SVA": "Subject–Verb Agreement",
}

MATCH_TYPES = {0: "UnknownWord", 1: "Hint", 2: "Other"}
SUGGESTION_TYPES = {0: "Default", 1: "Translation", 2: "Curated"}
STYLE_TAGS = {
    0: "picky",
    1: "academic",
    2: "clarity",
    3: "professional",
    4: "creative",
    5: "customer",
    6: "jobapp",
    7: "objective",
    8: "elegant",
}
CORRECTOR_KINDS = ["gector", "classifier", "coedit", "text2text", "openai"]
DEFAULT_PROMPT = "Fix grammatical errors: {{ text }}"
REPLACE_OPEN, REPLACE_CLOSE = "<|start_of_replace|>", "<|end_of_replace|>"
SEP_TOKEN, CLS_TOKEN = "<SEP>", "<CLS>"
# ----------------------------------------------------------------------------

# Names used where a match or its rule has none; parameters of the operators.
DEFAULT_RULE_ID = "redpen"
DEFAULT_SOURCE_FILE = "redpen"

# Closed word classes of English used to type edits.
CLOSED_CLASSES = {
    "DET": "a an the this that these those each every some any no another".split(),
    "PREP": (
        "of in to for with on at from by about into over after under between "
        "through during against without within towards upon"
    ).split(),
    "PRON": (
        "i you he she it we they me him her us them my your his its our their "
        "mine yours hers ours theirs who whom whose which"
    ).split(),
    "CONJ": "and or but nor so yet because although while if unless whereas".split(),
    "PART": "not up out off down away back".split(),
    "CONTR": "'s 'm 're 've 'll 'd n't".split(),
}

# A token of the typed path: clitics split off, single punctuation marks.
CLITIC = "(?:[nN]'[tT]|'(?:[sS]|[mM]|[rR][eE]|[vV][eE]|[lL][lL]|[dD]))"
# The same where no apostrophe occurs.
PLAIN_TOKEN = f"(?:{JAVA_WORD_RUN}|{JAVA_MARK})"
LIB_TOKEN = (
    f"(?:{WORD}+?(?=[nN]'[tT](?!{WORD}))|{CLITIC}(?!{WORD})|{WORD}+|"
    r"[^\p{L}\p{N}_" + WS[1:] + ")"
)
# A character outside the blocks whose letters, digits, marks and white space no version of Unicode changes:
# only without one do the patterns of Java and of Python find the same tokens everywhere.
NOT_STABLE = r"[\x{590}-\x{1fff}\x{2070}-\x{1f2ff}\x{1f650}-\x{10ffff}]"
