"""Word lists and tables of the Hindi transcript functions, as data, and helpers to use them in plans.

Everything between the two marks is a fixed value: results depend on exactly these words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ---------------------------------------------------------------------------------

#: Number words by value; where a number has two spellings, both.
NUMBER_WORDS = {
    0: "शून्य", 1: "एक", 2: "दो", 3: "तीन", 4: "चार", 5: "पाँच पांच", 6: "छः छह", 7: "सात", 8: "आठ", 9: "नौ",
    10: "दस", 11: "ग्यारह", 12: "बारह", 13: "तेरह", 14: "चौदह", 15: "पंद्रह", 16: "सोलह", 17: "सत्रह", 18: "अठारह", 19: "उन्नीस",
    20: "बीस", 21: "इक्कीस", 22: "बाईस", 23: "तेईस", 24: "चौबीस", 25: "पच्चीस", 26: "छब्बीस", 27: "सत्ताईस", 28: "अट्ठाईस", 29: "उनतीस",
    30: "तीस", 31: "इकतीस", 32: "बत्तीस", 33: "तैंतीस", 34: "चौंतीस", 35: "पैंतीस", 36: "छत्तीस", 37: "सैंतीस", 38: "अड़तीस", 39: "उनतालीस",
    40: "चालीस", 41: "इकतालीस", 42: "बयालीस", 43: "तैंतालीस", 44: "चवालीस", 45: "पैंतालीस", 46: "छियालीस", 47: "सैंतालीस", 48: "अड़तालीस", 49: "उनचास",
    50: "पचास", 51: "इक्यावन", 52: "बावन", 53: "तिरपन", 54: "चौवन", 55: "पचपन", 56: "छप्पन", 57: "सत्तावन", 58: "अट्ठावन", 59: "उनसठ",
    60: "साठ", 61: "इकसठ", 62: "बासठ", 63: "तिरसठ", 64: "चौंसठ", 65: "पैंसठ", 66: "छियासठ", 67: "सड़सठ", 68: "अड़सठ", 69: "उनहत्तर",
    70: "सत्तर", 71: "इकहत्तर", 72: "बहत्तर", 73: "तिहत्तर", 74: "चौहत्तर", 75: "पचहत्तर", 76: "छिहत्तर", 77: "सतहत्तर", 78: "अठहत्तर", 79: "उन्यासी",
    80: "अस्सी", 81: "इक्यासी", 82: "बयासी", 83: "तिरासी", 84: "चौरासी", 85: "पचासी", 86: "छियासी", 87: "सत्तासी", 88: "अट्ठासी", 89: "नवासी",
    90: "नब्बे", 91: "इक्यानवे", 92: "बानवे", 93: "तिरानवे", 94: "चौरानवे", 95: "पचानवे", 96: "छियानवे", 97: "सत्तानवे", 98: "अट्ठानवे", 99: "निन्यानवे",
}
MULTIPLIER_WORDS = {100: "सौ", 1_000: "हज़ार हजार", 100_000: "लाख", 10_000_000: "करोड़ करोड", 1_000_000_000: "अरब"}
ORDINALS = ("पहला", "पहली", "पहले", "दूसरा", "दूसरी", "दूसरे", "तीसरा", "तीसरी", "तीसरे", "चौथा", "पाँचवाँ", "छठा", "सातवाँ", "आठवाँ", "नौवाँ", "दसवाँ")
#: Phrases in which number words are no numbers.
IDIOMS = (
    "दो-चार", "दो चार", "चार-छह", "दो तीन", "दो-तीन", "तीन-चार", "पाँच-छह", "एक-दो", "सात-आठ", "नौ-दस", "चार पाँच", "दस-पंद्रह", "एक न एक", "दो टूक", "तीन तेरह",
    "चार चाँद", "सात समुद्र", "नौ दो ग्यारह", "दस बीस",
)
DEVANAGARI_DIGITS = "०१२३४५६७८९"
#: English words and their usual Devanagari spelling: those that text is rewritten with, and further ones.
REWRITTEN = (
    ("interview", "इंटरव्यू"), ("computer", "कंप्यूटर"), ("mobile", "मोबाइल"), ("phone", "फ़ोन"), ("online", "ऑनलाइन"), ("offline", "ऑफलाइन"), ("class", "क्लास"), ("college", "कॉलेज"),
    ("school", "स्कूल"), ("job", "जॉब"), ("work", "वर्क"), ("team", "टीम"), ("manager", "मैनेजर"), ("company", "कंपनी"), ("office", "ऑफिस"), ("business", "बिज़नेस"),
    ("problem", "प्रॉब्लम"), ("solution", "सॉल्यूशन"), ("success", "सक्सेस"), ("youtube", "यूट्यूब"), ("whatsapp", "व्हाट्सएप"), ("facebook", "फेसबुक"), ("instagram", "इंस्टाग्राम"),
    ("video", "वीडियो"), ("podcast", "पॉडकास्ट"), ("startup", "स्टार्टअप"), ("internship", "इंटर्नशिप"), ("percentage", "परसेंटेज"), ("result", "रिज़ल्ट"),
)
FURTHER = (
    ("technology", "टेक्नोलॉजी"), ("training", "ट्रेनिंग"), ("marketing", "मार्केटिंग"), ("software", "सॉफ्टवेयर"), ("hardware", "हार्डवेयर"), ("data", "डेटा"), ("server", "सर्वर"),
    ("cloud", "क्लाउड"), ("app", "ऐप"), ("app", "एप"), ("website", "वेबसाइट"), ("email", "ईमेल"), ("laptop", "लैपटॉप"),
)
SUFFIXES = (
    "ना", "ने", "नी", "कर", "के", "की", "को", "में", "से", "पर", "तक", "वाला", "वाली", "वाले", "ओं", "ाँ", "ों", "ें", "ता", "ती", "ते", "या", "यी", "ए", "इए", "ाएगा", "ाएगी",
    "गा", "गी", "गे", "ान", "ाना", "ाने", "ानी", "ाओ", "ाई", "ाइए", "ाइयाँ", "त्व", "ित", "इत",
)
MATRAS = "ािीुूृेैोौ"
VIRAMA, ANUSVARA, CHANDRABINDU, VISARGA, NUKTA = "्", "ं", "ँ", "ः", "़"
#: A word with any of these is no Hindi word: doubled signs, Roman letters, digits only, special characters.
INVALID_WORD = r"्{2,}|ं{2,}|ः{2,}|ँ{2,}|[aiueo]{2,}|[A-Za-z]|(?U:^\d+$)|[!@#$%^&*()+=\[\]{};:\"<>,./\\|`~]"
#: Numbers that a word lattice takes as equal to words.
LATTICE_NUMBERS = {1: "एक", 2: "दो", 3: "तीन", 4: "चार", 5: "पाँच पांच", 6: "छः छह", 7: "सात", 8: "आठ", 9: "नौ", 10: "दस", 11: "ग्यारह", 12: "बारह", 13: "तेरह", 14: "चौदह", 15: "पंद्रह", 20: "बीस", 25: "पच्चीस", 30: "तीस", 50: "पचास", 100: "सौ", 1000: "हज़ार हजार", 100000: "लाख"}
SYNONYMS = {
    "किताबें": "पुस्तकें", "पुस्तकें": "किताबें", "खरीदीं": "खरीदी", "खरीदी": "खरीदीं", "उसने": "उन्होंने", "बहुत": "काफ़ी काफी", "काफी": "काफ़ी बहुत", "काफ़ी": "काफी बहुत",
    "ठीक": "सही", "सही": "ठीक", "देखना": "देखने", "आना": "आने",
}
#: Error categories: description, name of the fix, its approach and effort.
CATEGORIES = {
    "phoneme_confusion": ("Acoustically similar phonemes are confused in decoding.", "Phoneme-aware post-correction", "Use confusion-pair dictionary and context scoring for common Devanagari phoneme substitutions.", "Medium"),
    "word_boundary": ("Word segmentation errors such as fusion or split tokens.", "Boundary restoration pass", "Apply token-merge/split rules based on Hindi lexicon and confidence-guided boundaries.", "Medium"),
    "english_loanword": ("Loanword rendering inconsistencies in Hindi context.", "Roman→Devanagari loanword correction", "Detect Roman tokens and transliterate/tag loanwords to match submission conventions.", "Low"),
    "accent_dialect": ("Regional pronunciation variation affects recognition.", "Dialect-aware adaptation", "Add accent-diverse samples and targeted fine-tuning for high-variance phones.", "High"),
    "number_handling": ("Number words/digits are inconsistently recognized.", "Numeric normalization layer", "Normalize number variants (word/digit) before and after decoding for consistency.", "Low"),
}
OTHER_CATEGORY = ("Error category discovered from live sampled hypotheses.", "Mitigate {}", "Targeted post-processing and additional supervised samples.", "Medium")

# --- End of fixed values --------------------------------------------------------------------------

ONES = {word: value for value, words in NUMBER_WORDS.items() for word in words.split()}
MULTIPLIERS = {word: value for value, words in MULTIPLIER_WORDS.items() for word in words.split()}
LATTICE_DIGITS = {word: str(value) for value, words in LATTICE_NUMBERS.items() for word in words.split()}
#: Longest first; among equals by code point, so that results do not depend on the order of a set.
IDIOM_ORDER = tuple(sorted(IDIOMS, key=lambda p: (-len(p), p)))
TO_DEVANAGARI = dict(REWRITTEN)
LOAN_SPELLINGS = tuple(deva for _, deva in REWRITTEN + FURTHER)


def literal_map(pairs: dict) -> Column:
    """A constant map column; Catalyst folds it."""
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def literal_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values))
