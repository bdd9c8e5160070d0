"""Readability formulas, as SQL arithmetic over counts so that every engine computes them in one order of operations.

Counts (doubles): w words, s sentences, p paragraphs, chars characters of words, syll syllables, mono and poly words of one and of three or
more syllables, long7 words of over six letters, hard words of two or more syllables that no easy-word list has, hard3 those of three
or more, mini words of at most three characters, body characters that are not blanks, types distinct words; w100, s100 and poly100 of the first
hundred words between blanks.
"""

from __future__ import annotations

#: The published constants.
FORMULAS = {
    "flesch_reading_ease": "206.835 - 1.015 * (w / s) - 84.6 * (syll / w)",
    "flesch_kincaid_grade": "0.39 * (w / s) + 11.8 * (syll / w) - 15.59",
    "gunning_fog": "0.4 * (w / s + 100 * (poly / w))",
    "smog_index": "1.043 * sqrt(30 * (poly / s)) + 3.1291",
    "automated_readability_index": "4.71 * (chars / w) + 0.5 * (w / s) - 21.43",
    "coleman_liau_index": "5.88 * (chars / w) - 29.6 * (s / w) - 15.8",
    "lix": "w / s + 100 * (long7 / w)",
    "rix": "long7 / s",
    "linsear_write_formula": "CASE WHEN ((w100 - poly100) + 3 * poly100) / s100 > 20 THEN ((w100 - poly100) + 3 * poly100) / s100 / 2 ELSE (((w100 - poly100) + 3 * poly100) / s100 - 2) / 2 END",
    "dale_chall_readability_score": "0.1579 * (100 * (hard / w)) + 0.0496 * (w / s) + CASE WHEN hard / w > 0.05 THEN 3.6365 ELSE 0 END",
    "spache_readability": "0.141 * (w / s) + 0.086 * (100 * (hard / w)) + 0.839",
    "mcalpine_eflaw": "(w + mini) / s",
    "reading_time": "body * 14.69 / 1000",
    "fernandez_huerta": "206.84 - 60 * (syll / w) - 1.02 * (w / s)",
    "szigriszt_pazos": "206.835 - 62.3 * (syll / w) - w / s",
    "gutierrez_polini": "95.2 - 9.7 * (chars / w) - 0.35 * (w / s)",
    "crawford": "-20.5 * (s / w) + 4.9 * (syll / w) - 3.407",
    "gulpease_index": "300 * (s / w) - 10 * (chars / w) + 89",
    "wiener_sachtextformel_1": "0.1935 * (100 * (poly / w)) + 0.1672 * (w / s) + 0.1297 * (100 * (long7 / w)) - 0.0327 * (100 * (mono / w)) - 0.875",
    "wiener_sachtextformel_2": "0.2007 * (100 * (poly / w)) + 0.1682 * (w / s) + 0.1373 * (100 * (long7 / w)) - 2.779",
    "wiener_sachtextformel_3": "0.2963 * (100 * (poly / w)) + 0.1905 * (w / s) - 1.1144",
    "wiener_sachtextformel_4": "0.2744 * (100 * (poly / w)) + 0.2656 * (w / s) - 1.693",
    "characters_per_word": "chars / w",
    "syllables_per_word": "syll / w",
    "words_per_sentence": "w / s",
    "sentences_per_paragraph": "s / p",
    "type_token_ratio": "types / w",
    "difficult_words": "hard",
    "complex_words_dc": "hard",
    "complex_words": "poly",
    "long_words": "long7",
    "words": "w",
    "lexicon_count": "w",
    "sentence_count": "s",
    "paragraphs": "p",
    "letter_count": "chars",
    "char_count": "body",
    "syllable_count": "syll",
    "polysyllable_count": "poly",
    "monosyllable_count": "mono",
    "word_types": "types",
}
#: The grade levels that text_standard takes the most frequent of, rounded down and up.
GRADES = ("flesch_kincaid_grade", "smog_index", "coleman_liau_index", "automated_readability_index", "dale_chall_readability_score", "linsear_write_formula", "gunning_fog")
#: Closed word classes of the word-usage measures, English.
USAGE = {
    "to_be_verbs": ("be", "being", "was", "were", "been", "are", "is"),
    "auxiliary_verbs": ("will", "shall", "cannot", "may", "need", "would", "should", "could", "might", "must", "ought", "can"),
    "conjunctions": ("and", "but", "or", "yet", "nor"),
    "pronouns": ("i", "me", "we", "us", "you", "he", "him", "she", "her", "it", "they", "them", "thou", "thee", "ye", "myself", "yourself", "himself", "herself", "itself", "ourselves", "yourselves", "themselves", "oneself", "my", "mine", "his", "hers", "yours", "ours", "theirs", "its", "our", "that", "their", "these", "this", "those", "your"),
    "prepositions": ("aboard", "about", "above", "according", "across", "after", "against", "along", "around", "at", "before", "behind", "below", "beneath", "beside", "between", "beyond", "by", "during", "for", "from", "in", "into", "like", "of", "on", "onto", "over", "through", "to", "toward", "under", "until", "up", "upon", "with", "within", "without"),
    "interrogatives": ("why", "who", "what", "whom", "when", "where", "how"),
    "articles": ("the", "a", "an"),
    "subordinations": ("after", "because", "lest", "till", "although", "before", "now", "unless", "as", "even", "provided", "until", "if", "since", "when", "so", "than", "whenever", "though", "whereas", "while"),
}
#: Suffix and least length of a nominalisation.
NOMINAL = ("(tion|ment|ence|ance)$", 8)
