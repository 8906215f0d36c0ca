"""Worked examples of the transcript functions, and properties."""

import random

import pytest
from pyspark.sql import functions as F

from vaaksetu.functions import errors, loanwords, numbers, spelling, text, wer
from vaaksetu.functions.lexicon import NUMBER_WORDS
from vaaksetu.operators.alignment import align_words

# Published or derived results that the functions must give.
NUMBERS = {
    "दो": "2", "दस": "10", "सौ": "100", "पच्चीस": "25", "तीन सौ चौवन": "354", "एक हज़ार": "1000", "दो-चार बातें करनी हैं": "दो-चार बातें करनी हैं",
    "मेरी उम्र पच्चीस साल है": "मेरी उम्र 25 साल है", "": "", "कोई संख्या नहीं": "कोई संख्या नहीं", "दो लाख तीन हज़ार चार सौ पच्चीस": "203425",
    "एक हज़ार रुपये दो": "1000 रुपये 2", "नौ दो ग्यारह हो गए": "नौ दो ग्यारह हो गए", "नौ दो ग्यारह पच्चीस": "नौ दो ग्यारह पच्चीस", "सौ नौ दो ग्यारह": "122",
    "हजारों लोग वहां थे": "1000ों लोग वहां थे", "हज़ारों लोग": "1000 लोग", "लाखों लोग": "लाखों लोग", "दो लाखों": "दो लाखों", "एक दो": "3", "दोस्त पीछे": "2स्त पी6",
    "एक करोड़ लाख": "10100000", "दो सौ सौ": "20000", "शून्य सौ": "100", "सौ हज़ार": "100000", "नौसौ": "9100", "उन्नतीस": "उन्न30",
}

SPELLING = {
    "है": ("correct", "high"), "ज़्यादा": ("correct", "high"), "प्रॉब्लम": ("correct", "high"), "लोगवाला": ("correct", "medium"), "अनबात": ("correct", "medium"),
    "abc": ("incorrect", "high"), "काा": ("incorrect", "high"), "हु": ("correct", "low"), "कताबें": ("correct", "low"), "करवाना": ("correct", "low"),
    "बजत": ("incorrect", "low"), "हज़ार": ("incorrect", "low"), "लिए": ("incorrect", "low"), "।": ("correct", "high"), "  ": ("incorrect", "high"),
}

ERRORS = [
    ("की", "के", ["Punctuation Only"]), ("घर है", "घर है।", ["Punctuation Only"]), ("दो लोग", "2 लोग", ["Number Format Mismatch"]), ("2 लोग", "दो लोग", ["Number Format Mismatch"]),
    ("लोग 5", "लोग", ["Word Deletion"]), ("app घर", "एप घर", ["English Loan Word Error"]), ("वे हैं", "ये हैं", ["Homophone Substitution"]),
    ("घर जा", "घर घर जा", ["Word Repetition", "Word Insertion/Hallucination"]), ("क ख ग घ", "क ख", ["Word Deletion"]), ("क ख", "क ख ग", ["Word Insertion/Hallucination"]), ("काम", "नाम", ["Other"]),
]


def apply(spark, f, values, schema="t string"):
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.out for r in rows.select("i", f(*[F.col(c) for c in rows.columns[1:]]).alias("out")).orderBy("i").collect()]


def test_numbers(spark):
    assert apply(spark, numbers.normalize_numbers, list(NUMBERS)) == list(NUMBERS.values())
    assert [numbers.normalize_text(t) for t in NUMBERS] == list(NUMBERS.values())
    assert apply(spark, lambda c: numbers.normalize_numbers(c, word_boundary=True), ["दोस्त पीछे", "हजारों लोग", "दो लोग"]) == ["दोस्त पीछे", "हजारों लोग", "2 लोग"]


def test_native_numbers_agree_with_python(spark):
    rng = random.Random(4)
    some = [*NUMBER_WORDS, "बातें", "चांद", "ना", "साथ", "दोस्त", "x", "सैकड़ों"]
    texts = ["".join(rng.choice(some) + rng.choice([" ", "  ", "\t", " ", "-", ""]) for _ in range(rng.randrange(1, 9))) for _ in range(400)] + [None]
    assert apply(spark, numbers.normalize_numbers, texts) == [numbers.normalize_text(t) for t in texts] == apply(spark, numbers.normalize_numbers_arrow, texts)


def test_round_trip(spark):
    rng = random.Random(1)
    n = [0, 1, 99, 100, 101, 10**9 - 1, *(rng.randrange(10**9) for _ in range(200))]
    assert apply(spark, lambda c: numbers.normalize_numbers(numbers.spell_number(c)), n, "t long") == list(map(str, n))


def test_loans(spark):
    words = ["इंटरव्यू", "जॉब", "प्रोग्रामिंग", "स्टूडेंट्स", "टिकट।", "मल", "interview"]
    assert apply(spark, loanwords.romanize, words[:6]) == ["intrvyoo", "job", "programing", "stoodents", "tikt।", "ml"]
    assert apply(spark, loanwords.loan_method, words) == ["dictionary", "dictionary", "fuzzy_transliteration", "none", "none", "none", "empty"]
    assert apply(spark, loanwords.tag_loans, ["ये प्रॉब्लम सॉल्व नहीं हो रहा", "(जॉब), टिकट।  interview 12"]) == ["ये [EN]प्रॉब्लम[/EN] [EN]सॉल्व[/EN] नहीं हो रहा", "([EN]जॉब[/EN]), टिकट। interview 12"]


def test_spelling(spark):
    vocabulary = ["है", "ज्यादा", "लोग", "बात", "कर"]
    got = apply(spark, lambda c: spelling.classify_word(c, vocabulary), list(SPELLING))
    assert [(g.spelling, g.confidence) for g in got] == list(SPELLING.values())


def test_text(spark):
    line = "मेरा interview बहुत अच्छा गया - और मुझे जॉब मिल गई।"
    assert apply(spark, text.clean_text, [line, "  a  b ", None]) == [line.replace(" - ", " "), "a b", None]
    assert apply(spark, text.align_tokens, ["दो-चार बातें, ठीक॥", "।!?", ""]) == [["दोचार", "बातें", "ठीक॥"], [], []]
    assert apply(spark, text.tokens, ["　a \x1c b "]) == [["a", "b"]]


def test_errors(spark):
    assert apply(spark, errors.classify_error, [(r, p) for r, p, _ in ERRORS], "r string, p string") == [c for *_, c in ERRORS]
    assert apply(spark, lambda r, p: errors.homophone(r, p, whole_words=True), [("वे हैं", "ये हैं"), ("वह", "वो")], "r string, p string") == [False, True]


def test_wer_and_alignment(spark):
    rng = random.Random(2)
    pairs = [([rng.choice("abcd") for _ in range(rng.randrange(9))], [rng.choice("abcd") for _ in range(rng.randrange(9))]) for _ in range(150)]
    schema = "r array<string>, h array<string>"
    edits = apply(spark, wer.word_edits, pairs, schema)
    steps = [align_words(r, h) for r, h in pairs]
    assert edits == [sum(op != "M" for op, *_ in s) for s in steps]
    assert edits == apply(spark, lambda r, h: wer.lattice_edits(F.transform(r, lambda w: F.array(w)), h), pairs, schema)
    wide = apply(spark, lambda r, h: wer.lattice_edits(F.transform(r, lambda w: F.array(w, F.lit("a"))), h), pairs, schema)
    assert all(a <= b for a, b in zip(wide, edits))
    assert align_words("ab", "bc") == [("S", 0, 0), ("S", 1, 1)] and align_words("aa", "a") == [("D", 0, None), ("M", 1, 0)]
    rates = apply(spark, wer.standard_wer, [([], []), ([], ["a"]), (["a"], [])], schema)
    assert rates == [0.0, float("inf"), 1.0]
    assert apply(spark, wer.sample_wer, [(" ", "x"), ("a b", "a c")], "r string, p string") == [0.0, 0.5]


@pytest.mark.parametrize("word", ["चीज़", "abc"])
def test_null_is_null(spark, word):
    assert apply(spark, numbers.normalize_numbers, [None]) == [None]
    assert apply(spark, text.fold_nuqta, [word, None])[1] is None


# Published words of low confidence, the class after the word where it isn't "incorrect".
REVIEWED = """
कहलो कैराम माध्यम। वोकेलबरी सॉल्टी मैलापन=correct मेरी-मेरी सब्र ओटीटी वोहा व्यक्तिकत लगाई। मेंलेवर अनुभुवो हैयह वैकेनिक अक्वार्ड बटकाता=correct एक्सटिमेंट दयत
सबकार एब्जॉर्ब लिंक्ड सुधारते=correct पकेरा निरस्ट प्रशिक्ता=correct पावंदिया=correct न्यूनियन चरली=correct आँछी इंसिस्ट नमियों=correct समरम करोड़ी काहो इंग्लेंड बोर्च
पेरेन्टस आदमिनिट एलोबोरेट पीकाचू उजाकर=correct बेवी रहुंगी=correct चीचीजों=correct रिखान एक्सवल बन, बुलाती,
"""


def test_published_review(spark):
    words = [w.split("=") for w in REVIEWED.split()]
    got = apply(spark, spelling.classify_word, [w[0] for w in words])
    assert [(g.spelling, g.confidence) for g in got] == [((w + ["incorrect"])[1], "low") for w in words]


def test_composition_is_for_texts_that_need_it(spark):
    import unicodedata

    rng = random.Random(9)
    some = [chr(c) for c in (0x41, 0xE9, 0x65, 0x301, 0x928, 0x93C, 0x958, 0x2013, 0x2019, 0x212B, 0xAC00, 0x1100, 0x1161, 0x20, 0x30)]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(8))) for _ in range(300)]
    plain = [" ".join("".join(c if "\u0900" <= c <= "\u097f" or c in " \t\n" or (c.isascii() and c.isalnum()) else " " for c in unicodedata.normalize("NFC", t)).split()) for t in texts]
    assert apply(spark, text.clean_text, texts) == plain


def test_core_vocabulary(spark):
    """The core vocabulary's size is a fixed value; its words are right, and forms with known endings are derived from it."""
    from vaaksetu.functions.lexicon import CORE_VOCABULARY

    assert len(CORE_VOCABULARY) == len(set(CORE_VOCABULARY)) == 271
    got = apply(spark, spelling.classify_word, [*CORE_VOCABULARY, "लोगवाला", "अनबात", "ज़्यादा"])
    assert {(g.spelling, g.confidence) for g in got[:271]} == {("correct", "high")}
    assert [g.confidence for g in got[271:]] == ["medium", "medium", "high"]
