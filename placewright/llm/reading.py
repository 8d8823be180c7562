"""Reading level of documents from classic readability formulas.

Texts are read once, in Arrow batches: a text is cleaned, cut into sentences and
words, and every distinct word is measured once per task (letters, syllables). Syllables
come from hyphenation patterns: strings of letters with digits at the places where
a word may be broken (odd) or must not be (even); of all patterns that fit a word the
greatest digit counts at each place, as in typesetting, and a word has one syllable
more than places to break it. Six grade estimates (Flesch-Kincaid, fog, automated readability,
Coleman-Liau, SMOG, LIX as a grade) are combined by their median. Two thresholds
per language turn the grade into a level; they are those that agree with most
ratings, found on a histogram of all rated documents (at most
``2 * GRADE_BINS * levels`` numbers reach the driver, whatever the corpus holds).
The grades are kept in the checkpoint folder, so that rated texts aren't read twice.

Cleaning: tags of any length and character entities are resolved, text that was decoded wrongly is
mended where it spells UTF-8, invisible characters inside
words dropped, words hyphenated at a line's end joined, decimal points and a few
titles don't end sentences; in lists, a new line that begins with a bullet or
a capital does.

Defined results: null, empty and short texts (under ``min_words``) give no row;
a language that isn't written in one of the known ways is told by the commonest
words (French on a tie); repeated ratings count once per document and rater;
without any rating of a language the thresholds of all languages together hold,
and without any rating at all ``DEFAULT_CUTS``; texts are read whole.
"""

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placewright.plans.cut import cut

GRADE_BINS = 600
BIN = 0.1
DEFAULT_CUTS = (6.0, 12.0)
FRENCH = "le la les de du des et un une est au pour on il ce"
ENGLISH = "the of and to is in a at for you it my we by"

# Hyphenation patterns. V is any vowel, C any consonant, . the word's end or begin. Between two groups of vowels a
# word is broken once, before the last consonant or an inseparable pair.
PAIRS = "bl br cl cr dr fl fr gl gr pl pr tr vr ch ph th".split()
COMMON = "V1CV VC1CV VCC1CV VCCC1CV VCCCC1CV " + " ".join(f"V3{a}4{b}V C3{a}4{b}V" for a, b in PAIRS)
#: Silent endings don't make a syllable; accented vowels sound, and part from most vowels beside them.
FRENCH_PATTERNS = COMMON + " V3g4nV C3g4nV 6Ce. 6Ces. 6Cent. " + " ".join(f"8{a}8{b}e. 8{a}8{b}es. 8{a}8{b}ent." for a, b in [*PAIRS, "gn"]) + " V9ment. a1é e1é o1é u1é a1è o1è é1a é1â é1e é2e. é2es. é1o é1i é1u u1ï a1ï o1ï é1ï ï1a ï1e ï1o V1ë a1o"
ENGLISH_PATTERNS = COMMON + " 6Ce. 6Ces. 6Ced. V9Cle. C9Cle. V9Cles. C9Cles. 9ses. 9zes. 9xes. 9ces. 9ges. 9ches. 9shes. 9ted. 9ded. i1a i1o ti4a ti4o ci4a ci4o si4o gi4o u1a qu4a gu4a de1o ne1o re1o te1o e1u i1u ti4u u1o eo4u e1a. e1as."
VOWELS = "aeiouyàâäáãåæéèêëíìîïóòôöõœúùûüýÿ"
CONSONANTS = "bcdfghjklmnpqrstvwxzçñ"


def breaker(patterns: str):
    """A function from a word in lower case to its number of syllables."""
    import re
    from itertools import product

    kinds = {"V": VOWELS, "C": CONSONANTS}
    levels: dict[str, list] = {}
    for p in patterns.split():
        parts = re.findall(r"(\d?)([^\d])", p)
        digits = [int(n or 0) for n, _ in parts]
        # patterns of kinds alone are met by a word's kinds, the others are written out
        mixed = any(c not in kinds for _, c in parts)
        for letters in product(*(kinds[c] if mixed and c in kinds else c for _, c in parts)):
            old = levels.get("".join(letters), digits)
            levels["".join(letters)] = [max(a, b) for a, b in zip(old, digits, strict=True)]
    begins = {w[:n] for w in levels for n in range(1, len(w) + 1)}
    kind_of = str.maketrans({**dict.fromkeys(VOWELS, "V"), **dict.fromkeys(CONSONANTS, "C")})
    shapes: dict[str, list] = {}

    def fit(form: str, best: list) -> list:
        size = len(form)
        for i in range(size):
            n = i + 1
            while n <= size and (w := form[i:n]) in begins:
                found = levels.get(w)
                if found:
                    for k, d in enumerate(found, i):
                        if d > best[k]:
                            best[k] = d
                n += 1
        return best

    def syllables(word: str) -> int:
        shape = f".{word.translate(kind_of)}."
        first, last = shape.find("V"), shape.rfind("V")
        if first < 0:
            return 1
        best = shapes.get(shape)
        if best is None:
            if len(shapes) > 100_000:
                shapes.clear()
            best = shapes[shape] = fit(shape, [0] * len(shape))
        best = fit(f".{word}.", best.copy())
        return 1 + sum(d & 1 for d in best[first + 1 : last + 1])

    return syllables


def _measurer():
    """A function from texts to their counts, and the memory of measured words it keeps."""
    import html
    import re
    import unicodedata

    import numpy as np

    tag = re.compile(r"</?[A-Za-z][^<>]*>")
    invisible = re.compile("[­͏؜᠎​-‏‪-‮⁠-⁤︀-️﻿]")
    broken = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t]*(?=[^\W\d_])")
    wrong = re.compile("[\u0080-\U0010ffff]+")
    bullet = re.compile(r"^[ \t]*[-*•] ", re.M)
    item = re.compile(r"[\r\n]+\s*(?:[-*•] +|(?=[A-ZÀ-ÖØ-Þ]))")
    blank = re.compile(r"(?:\r?\n[ \t]*){2,}")
    decimal = re.compile(r"(?<=\d)[.,:](?=\d)")
    title = re.compile(r"\b(M|Mme|Mr|Mrs|Dr|St|No)\.")
    sentence = re.compile(r"[^\W_][^.!?…]*")
    word = re.compile(r"[^\W_]+")
    french, english = set(FRENCH.split()), set(ENGLISH.split())

    def mended(m):
        try:
            return m[0].encode("cp1252").decode()
        except ValueError:
            return m[0]

    class Words(dict):
        """From a word to its row of ``features``."""

        def __init__(self, syllables):
            self.syllables, self.features = syllables, np.zeros((1024, 6), dtype=np.int32)

        def __missing__(self, w):
            n = self[w] = len(self)
            if n >= len(self.features):
                self.features = np.concatenate([self.features, np.zeros_like(self.features)])
            letters = sum(c.isalpha() for c in w)
            if letters:
                s = self.syllables(w)
                self.features[n] = (1, 1, letters, letters > 6, s, s > 2)
            else:
                self.features[n, 0] = 1
            return n

    known = {"fr": Words(breaker(FRENCH_PATTERNS)), "en": Words(breaker(ENGLISH_PATTERNS))}

    def cleaned(text):
        t = tag.sub(" ", text) if "<" in text else text
        t = html.unescape(t) if "&" in t else t
        if "Ã" in t or "Â" in t or "â€" in t:
            t = wrong.sub(mended, t)
        if not t.isascii():
            t = unicodedata.normalize("NFC", invisible.sub("", t))
            lone = "".join(c for c in set(t) if c > "˿" and unicodedata.category(c)[0] == "M")
            if lone:
                t = t.translate(dict.fromkeys(map(ord, lone)))
        if "-" in t:
            t = broken.sub("", t)
        if "\n" in t or "\r" in t:
            t = item.sub(" . ", t) if bullet.search(t) else blank.sub(" . ", t)
        return title.sub(r"\1", decimal.sub("", t))

    def measure(texts, told):
        """Of each text: its language (``told``, or by its commonest words), sentences, and the sums of its words' features."""
        tongues, sentences = [], []
        flat = {"fr": [], "en": []}
        ends = {"fr": [0], "en": [0]}
        for text, tongue in zip(texts, told, strict=True):
            t = cleaned(text) if text else ""
            words = word.findall(t.lower())
            if tongue not in flat:
                tongue = "fr" if sum(w in french for w in words) >= sum(w in english for w in words) else "en"
            sentences.append(len(sentence.findall(t)))
            tongues.append(tongue)
            flat[tongue] += words
            ends[tongue].append(len(flat[tongue]))
        out = np.zeros((len(tongues), 6), dtype=np.int64)
        for tongue, words in flat.items():
            own = known[tongue]
            rows = np.fromiter(map(own.__getitem__, words), dtype=np.int64, count=len(words))
            sums = np.zeros((len(words) + 1, 6), dtype=np.int64)
            np.cumsum(own.features[rows], axis=0, out=sums[1:])
            at = np.array(ends[tongue])
            out[np.array([x == tongue for x in tongues], dtype=bool)] = sums[at[1:]] - sums[at[:-1]]
            if len(own) > 1_000_000:  # the memory starts anew; results don't depend on it
                own.clear()
        return tongues, np.array(sentences, dtype=np.int64), out

    return measure


COUNTS = "n_words n_alpha n_letters n_long n_syllables n_complex n_sentences".split()


def measures(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key``, ``tongue`` (fr, en) and the counts behind the formulas."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        measure = _measurer()
        for batch in batches:
            for part in (batch.slice(begin, 500) for begin in range(0, batch.num_rows, 500)):
                told = [(x or "").strip().lower()[:2] for x in part.column(1).to_pylist()]
                tongues, sentences, f = measure(part.column(2).to_pylist(), told)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tongues, pa.string()), *(pa.array(f[:, c]) for c in range(6)), pa.array(np.maximum(sentences, 1))], names=["k", "tongue", *COUNTS])

    rows = df.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"))
    return rows.mapInArrow(run, f"k {kind}, tongue string, " + ", ".join(f"{c} bigint" for c in COUNTS)).withColumnRenamed("k", key)


def grade() -> Column:
    """The median of six grade estimates."""
    words, alpha = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("n_alpha"), F.lit(1)).cast("double")
    w = words / F.col("n_sentences")
    s, letters, c, long = F.col("n_syllables") / alpha, F.col("n_letters") / alpha, F.col("n_complex") / alpha, F.col("n_long") / alpha
    estimates = [0.39 * w + 11.8 * s - 15.59, 0.4 * (w + 100 * c), 4.71 * letters + 0.5 * w - 21.43, 5.88 * letters - 29.6 / w - 15.8, 1.043 * F.sqrt(30 * c * w) + 3.1291, (w + 100 * long) / 4]
    x = F.array_sort(F.array(*estimates))
    return (x[2] + x[3]) / 2


def graded(df: DataFrame, key: str, text: str, lang: str, min_words: int) -> DataFrame:
    """``key``, ``tongue``, ``n_words``, ``grade`` of every document with at least ``min_words`` words."""
    return measures(df, key, text, lang).where(F.col("n_words") >= min_words).select(key, "tongue", "n_words", grade().alias("grade"))


def best_cuts(counts: dict[tuple[int, int], int]) -> tuple[float, float]:
    """The two thresholds that agree with most ratings; counts by (bin, level)."""
    import numpy as np

    table = np.zeros((GRADE_BINS + 1, 3), dtype=np.int64)
    for (b, level), n in counts.items():
        table[b, level - 1] += n
    below = np.vstack([np.zeros((1, 3), dtype=np.int64), table.cumsum(0)])  # ratings in bins under b
    first = below[:, 0] - below[:, 1]
    second = below[:, 1] - below[:, 2]
    best = np.maximum.accumulate(first)
    at = int(np.argmax(second + best))
    low = np.flatnonzero(first[: at + 1] == best[at])
    high = np.flatnonzero(second + best == (second + best)[at])
    high = high[(high >= at) & (best[high] == best[at])]
    middle = lambda x: (x[0] + x[-1]) / 2 * BIN - 10
    return middle(low), middle(high)


def bin_of(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(GRADE_BINS), F.floor((c + 10) / BIN))).cast("int")


def fit_cuts(rated: DataFrame) -> dict[str, tuple[float, float]]:
    """Thresholds per language from ``tongue``, ``grade``, ``reading_level``; only the histogram is collected."""
    hist = rated.where("reading_level between 1 and 3").groupBy("tongue", bin_of(F.col("grade")).alias("b"), F.col("reading_level").cast("int").alias("level")).count().collect()
    cuts = {}
    every: dict = {}
    for tongue in ("fr", "en"):
        own = {(r.b, r.level): r["count"] for r in hist if r.tongue == tongue}
        for k, n in own.items():
            every[k] = every.get(k, 0) + n
        if own:
            cuts[tongue] = best_cuts(own)
    rest = best_cuts(every) if every else DEFAULT_CUTS
    return {t: cuts.get(t, rest) for t in ("fr", "en")}


def reading_levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = 45, min_rated_words: int = 20) -> DataFrame:
    """``key``, ``tongue``, ``n_words``, ``grade``, ``reading_level``."""
    every = cut(graded(documents.select(key, text, lang), key, text, lang, min(min_words, min_rated_words)))
    ratings = labels.select(key, "rater", "reading_level").distinct()
    rated = every.where(F.col("n_words") >= min_rated_words).join(ratings, key)
    cuts = fit_cuts(rated)
    of = lambda i: F.when(F.col("tongue") == "fr", cuts["fr"][i]).otherwise(cuts["en"][i])
    level = F.lit(1) + (F.col("grade") >= of(0)).cast("int") + (F.col("grade") >= of(1)).cast("int")
    return every.where(F.col("n_words") >= min_words).withColumn("reading_level", level.cast("int"))
