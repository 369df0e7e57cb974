"""Fixed values that results depend on: symbols, maps, word lists and patterns."""

# ---- fixed values ----

PREFIX = "translate Akkadian to English: "
REVERSE_PREFIX = "translate English to Akkadian: "

SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
DIGITS = "0123456789"
SCHOLARLY = "⌈⌉⌊⌋°"
BAD_OUTPUT = '!?()"—–<>⌈⌋⌊[]+ʾ/;'

FRACTIONS = {"1/2": "½", "1/3": "⅓", "2/3": "⅔", "1/4": "¼", "3/4": "¾", "1/5": "⅕", "1/6": "⅙", "5/6": "⅚", "1/8": "⅛"}

DECIMALS = [(r"\.5\b", "½"), (r"\.25\b", "¼"), (r"\.75\b", "¾"), (r"\.33+\d*\b", "⅓"), (r"\.66+\d*\b", "⅔")]

DICTIONARY = {
    "a-na": "To", "um-ma": "saying:", "IGI": "Witnesses:", "KIŠIB": "Seal of", "ma-na": "mina of silver", "šu-ma": "If he does not pay",
    "i-na": "In", "ITU.KAM": "Month:", "iš-tù": "From the", "KÙ.BABBAR": "silver", "GÍN": "shekels of silver", "ú-ṣa-áb": "he will add interest",
    "li-mu-um": "Eponymy of", "ù": "Also,", "ša": "of", "lá": "", "URUDU": "copper", "x": "", "…": "", "a-ma-kam": "Here",
    "en-um-a-šur": "Ennum-Aššur", "kà-ru-um": "The colony",
}
DICTIONARY_ASCII = DICTIONARY | {"lá": "not", "x": "broken", "…": "broken", "en-um-a-šur": "Ennum-Assur"}
DICTIONARY_ADAPTER = {
    "a-na": "To", "um-ma": "saying:", "IGI": "Witnesses:", "KIŠIB": "Seal of", "ma-na": "mina of silver", "šu-ma": "If he does not pay",
    "i-na": "In", "ša": "of", "u": "and", "ki-ma": "like", "DUMU": "son of", "ITI": "Month:", "MU": "Year:", "LUGAL": "king", "šar-ri": "king",
    "DINGIR": "god", "KUR": "land", "URU": "city", "NAM": "fate", "A": "water", "É": "house", "GIŠ": "wood",
}

DIACRITICS = "šŠṣṢṭṬḫḪāĀēĒīĪūŪàáèéìíòóùú"
DIACRITICS_ASCII = "sSsStThHaAeEiIuUaaeeiioouu"

DETERMINATIVE = r"\{(?:d|f|m|ki|kur|uru|lu2?|na4|gi[sš]|mul|u[dš]|an|i[dš]|tug2?|ku[sš])\}"
GRAMMAR = r"\((?:fem|plur|pl|sing|singular|plural|\?|!)\.?\s*\w*\)"
BRACKETED = r"[\(\[][^\)\]]*[\)\]]"
BROKEN_TOKEN = r"^[\[\(]?\.+[\]\)]?$|^x+$|^…$"
TEMPLATE_MARKERS = ["You are an expert", "RULES:", "Given the following", "Source:", "Translate it", "Do not add explanations", "Be concise and clear"]
SOURCE_WORDS = r"\b[a-zšṣṭḫāēīū]{2,}-[a-zšṣṭḫāēīū]{2,}"
SOURCE_WORD = r"\b[a-zšṣṭḫāēīū]+\b"
EDGE_MARKS = ".,;:!?()[]\"'"

GAP_RULES = [
    (r"\[\s*\.\s*\.\s*\.\s*\]", "<big_gap>"),
    (r"\(\s*\.\s*\.\s*\.\s*\)", "<big_gap>"),
    (r"\.{5,}", "<big_gap>"),
    (r"…{2,}", "<big_gap>"),
    (r"\.{3,4}", "<big_gap>"),
    (r"…", "<big_gap>"),
    (r"\[x+\]", "<gap>"),
    (r"xx+", "<gap>"),
    (r"\s+x\s+", " <gap> "),
    (r"<gap>(\s*<gap>)+", "<gap>"),
    (r"<big_gap>(\s*<big_gap>)+", "<big_gap>"),
]
OUTPUT_GAP_RULES = [
    (r"\.{3,}|…|\[\.+\]", "<big_gap>"),
    (r"<gap>\s*<gap>", " <big_gap> "),
    (r"<big_gap>\s*<big_gap>", " <big_gap> "),
]
SHORT_GAP_RULES = [(r"\.{3,}|…+", "<big_gap>"), (r"xx+|\s+x\s+", "<gap>")]
STRICT_GAP_RULES = [
    (r"\[\.{3,}\]|…{2,}|\.{5,}", "<big_gap>"),
    (r"xx+|\s+x\s+|\[x+\]", "<gap>"),
    (r"<gap>(\s*<gap>)+", "<gap>"),
    (r"<big_gap>(\s*<big_gap>)+", "<big_gap>"),
]
DOT_GAP_RULES = [(r"\[\s*\.\s*\.\s*\.\s*\]", "..."), (r"\(\s*\.\s*\.\s*\.\s*\)", "..."), (r"\.{3,}", "...")]
BRACED_RULES = [(r"\{([^}]+)\}-", r"(\1)"), (r"\{([^}]+)\}", r"\1")]
NOTE_RULES = [(r'\(lit\.\s*"[^"]*"\)', ""), (r"\(DN\s+and\)", "")]
REPEAT_RULES = [(r"\b(\w+)(?:\s+\1\b)+", r"\1"), *[(rf"\b((?:\w+\s+){{{n - 1}}}\w+)(?:\s+\1\b)+", r"\1") for n in (4, 3, 2)]]

# ---- end of fixed values ----
