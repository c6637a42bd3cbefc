"""Lists and sets that must equal the published definitions for results to match."""

# Characters Python treats as whitespace in ``str.split`` and in regex ``\s``.
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)

# The same characters inside a regex class, in the notation the JVM and RE2 share.
BLANK_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# Punctuation counted by the density measure.
DENSITY_PUNCTUATION = ".,!?;:\"'-–—()[]{}"

# Punctuation counted by the stylometric rate.
STYLE_PUNCTUATION = ".,!?;:"

# Fixed stop-word list of the stylometric features.
STYLE_STOPWORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "to",
    "of", "in", "for", "on", "with", "at", "by", "from", "up", "about", "into", "through",
    "during", "before", "after", "and", "but", "or", "nor", "so", "yet", "not", "no", "it",
    "its", "this", "that",
]

# Fixed hedge-word list of the stylometric features.
HEDGE_WORDS = [
    "perhaps", "maybe", "might", "could", "possibly", "likely", "somewhat", "generally",
    "often",
]

# Fixed English stop words, Spark's own list.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers", "herself",
    "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which",
    "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was", "were", "be",
    "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an",
    "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for",
    "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under",
    "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all",
    "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not",
    "only", "own", "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don",
    "should", "now", "i'll", "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd",
    "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't", "weren't",
    "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't", "wouldn't", "shan't",
    "shouldn't", "mustn't", "can't", "couldn't", "cannot", "could", "here's", "how's", "let's",
    "ought", "that's", "there's", "what's", "when's", "where's", "who's", "why's", "would",
)

# Fixed patterns and literals of the cleaning steps.
TAG_PATTERN = "<[^<>]*>"
URL_PATTERN = r"http[^ ]+|www\.[^ ]+"
PAD_WORD = "<PAD>"
MAX_WORDS = 500
BALANCED_MAX_WORDS = 300
SEED = 42

# Fixed settings of the published profiles.
DENSITY_SAMPLE = 3000
DENSITY_FACTOR = 0.3
DENSITY_POINTS = 300
DENSITY_CLIP = 0.99
LENGTH_DENSITY_POINTS = 1000
TERM_SAMPLE = 5000
TOP_TERMS = 15

# Denominator guard of the stylometric ratios.
EPSILON = 1e-8

# Names of the stylometric features, in output order.
STYLE_FEATURES = [
    "avg_word_len",
    "type_token_ratio",
    "avg_sent_len",
    "punct_rate",
    "flesch",
    "stopword_ratio",
    "sent_len_std",
    "bullet_rate",
    "question_rate",
    "paren_rate",
    "upper_ratio",
    "bigram_diversity",
    "syllable_score",
    "fog",
    "hedge_ratio",
]
