"""Problem 2: the language of every text and of every part of a mixed text.

Compression classification: a text part is compressed with one zstandard
raw-content dictionary per language, and the dictionary that leaves the fewest
bytes names the language. A part whose two smallest sizes are close is rejected
(language null). The dictionaries are fitted on a bounded sample of labelled
rows (``SAMPLE_TEXTS`` per language), cross-checked half against half so that
wrongly labelled texts don't stay in; every text is then split into sentences
and every sentence is classified whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import SparkContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Labelled texts per language that the dictionaries are fitted on, at most in expectation.
SAMPLE_TEXTS = 250
#: Sentences of one text that the fit looks at, at most.
SAMPLE_PARTS = 24
#: Bytes of one dictionary.
DICTIONARY_BYTES = 64 << 10
#: Bytes by which the best size must undercut the second for a part to count.
MARGIN = 3

#: The bibliographic three-letter codes of ISO 639-2, and usual names beside the JVM's own.
OTHER_NOTATIONS = """
sq alb|hy arm|eu baq|my bur|zh chi|cs cze|nl dut flemish|fr fre|ka geo|de ger|el gre|is ice|mk mac|mi mao|ms may|fa per farsi|ro rum moldavian
sk slo|bo tib|cy wel|es castilian|nb bokmål|nn nynorsk|ca valencian|no nor norwegian|zh mandarin|he iw|id in|yi ji
"""


@cache
def notations() -> dict[str, str]:
    """Every notation of a language to its two-letter code: ISO 639-1, 639-2 (either kind) and English names.

    The table is that of the JVM, which knows every two-letter code there is.
    """
    locale = SparkContext._active_spark_context._jvm.java.util.Locale
    found: dict[str, str] = {}
    for two in locale.getISOLanguages():
        own = locale.forLanguageTag(two)
        for word in (two, own.getISO3Language(), own.getDisplayLanguage(locale.ENGLISH).lower()):
            found.setdefault(word, two)
    for entry in OTHER_NOTATIONS.replace("\n", "|").split("|"):
        two, *words = entry.split() or [""]
        found |= {w: two for w in words}
    return found


_TAG = re.compile(r"[a-z]{2,3}([-_.@][a-z0-9_.@-]+)?|[^\W\d_]+( \([^)]*\))?")


def code(label):
    """Column: the two-letter code of a label in any usual notation, null if it names no language."""
    known = notations()

    def one(given: str | None) -> str | None:
        bare = given.strip(" ").lower()
        if bare in known:
            return known[bare]
        return known.get(re.split("[-_.@ (]", bare, maxsplit=1)[0]) if _TAG.fullmatch(bare) else None

    @F.pandas_udf(StringType())
    def run(labels: pd.Series) -> pd.Series:
        # labels are few: each is looked up once a batch
        return labels.map({x: one(x) for x in labels.unique() if x is not None}).astype(object)

    return run(label)


_SPACE = re.compile(r"[^\W\d_]+|[\d_]+|\s+|[^\w\s]+")
_BREAK = re.compile(r"(?<=[.!?…])[\s\"')\]»”’]+|(?<=[。！？])|\s*[;|]\s+")
_LINK = re.compile(r"https?://\S+|www\.\S+|\S+@\S+")
_ASIDE = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|[»«„“”\"‹›「『][^»«„“”\"‹›「」『』]*[«»“”\"›‹」』]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?…。！？][\s\"'”’»)\]]*(\s[–—-])?\s*$")
#: Words from which a part without final punctuation is a sentence, not a title.
UNPUNCTUATED_WORDS = 8


def fold(text: str) -> str:
    """Words alone, in lower case, so that layout and numbers don't count."""
    return " ".join(_WORD.findall(unicodedata.normalize("NFKC", text.lower())))


def bald(folded: str) -> str:
    """Without accents, as some transcribers write."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", folded) if not unicodedata.combining(c)))


def _words(text: str) -> int:
    return len(_WORD.findall(text)) if not _CJK.search(text) else max(len(_WORD.findall(text)), len(_CJK.findall(text)) // 3)


def parts(text: str, window: int = 10):
    """(start, end) of the sentences of a text, the whole text being covered in order.

    Lines that were wrapped belong together; a line that ends short of its
    paragraph's width ends a part. Runs without punctuation are cut into
    windows of ``window`` words.
    """
    out, at = [], 0
    for block in re.split(r"(\n\s*\n)", text):
        lines = block.split("\n")
        width = max(map(len, lines))
        begin = end = at
        for i, line in enumerate(lines):
            end += len(line) + (i < len(lines) - 1)
            # a following word that would have fitted shows that the break was meant
            following = lines[i + 1].split(" ", 1)[0] if i < len(lines) - 1 else ""
            if i == len(lines) - 1 or (len(line) + 1 + len(following) <= width - 4 and not line.rstrip().endswith(("-", "­"))):
                out.append((begin, end))
                begin = end
        at += len(block)
    cut = []
    for begin, end in out:
        piece, last = text[begin:end], 0
        bounds = [m.end() for m in _BREAK.finditer(piece)] + [len(piece)]
        for b in bounds:
            if b > last and piece[last:b].strip():
                cut.append((begin + last, begin + b))
                last = b
    final = []
    for begin, end in cut:
        piece = text[begin:end]
        tokens = [m for m in re.finditer(r"\S+", piece)]
        if len(tokens) > 2 * window and not _CJK.search(piece):
            n = round(len(tokens) / window)
            edges = [tokens[len(tokens) * i // n].start() for i in range(1, n)]
            for a, b in zip([0, *edges], [*edges, len(piece)]):
                final.append((begin + a, begin + b))
        else:
            final.append((begin, end))
    return final


def bare(piece: str) -> str:
    """A part without links, short asides and short quotations (names and titles), hyphenation undone."""
    piece = re.sub(r"(?<=\w)[-­]\s*\n\s*(?=\w)", "", piece)
    piece = _LINK.sub(" ", piece)
    return _ASIDE.sub(lambda m: m[0] if _words(m[0]) >= 5 else " ", piece)


class Classifier:
    """Dictionaries by language; ``sizes`` and ``best`` classify folded parts."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.dictionaries, self.level = dictionaries, level
        self.codes = sorted(dictionaries)
        self._open = None
        self._known: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": None, "_known": {}}

    def sizes(self, text: str) -> list[int]:
        if self._open is None:
            self._open = []
            for c in self.codes:
                d = zstandard.ZstdCompressionDict(self.dictionaries[c], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._open.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        data = text.encode()
        return [len(c.compress(data)) for c in self._open]

    def best(self, text: str):
        """(language or None, confidence, margin) of a folded part."""
        if (got := self._known.get(text)) is not None:
            return got
        sizes = np.asarray(self.sizes(text), dtype=float)
        order = np.argsort(sizes, kind="stable")
        margin = float(sizes[order[1]] - sizes[order[0]]) if len(sizes) > 1 else float(len(text))
        odds = np.exp2(-(sizes - sizes[order[0]]))
        got = (self.codes[order[0]] if margin >= MARGIN else None, float(1.0 / odds.sum()), margin)
        if len(self._known) > 200_000:
            self._known.clear()
        self._known[text] = got
        return got

    def backs(self, sentences: list[str], lang: str) -> bool:
        """Whether no dictionary shortens the sentences together more than that of ``lang``, or none does much."""
        total = np.sum([self.sizes(s) for s in sentences], axis=0)
        size = sum(len(s.encode()) for s in sentences)
        return lang in self.codes and (total[self.codes.index(lang)] == total.min() or total.min() > 0.85 * size)


def _dictionary(sentences: list[str], limit: int = DICTIONARY_BYTES) -> bytes:
    """The sentences that add most unseen word pairs, with and without accents, up to ``limit`` bytes."""
    seen: set[tuple[str, str]] = set()
    kept, size = [], 0
    for wanted in (0.6, 0.3, 0.05):
        for s in sentences:
            words = s.split()
            pairs = set(zip(words, words[1:])) if len(words) > 1 else {(s[i : i + 3], "") for i in range(0, len(s) - 2)}
            if pairs and len(pairs - seen) >= wanted * len(pairs):
                seen |= pairs
                kept.append(s)
                size += len(s.encode()) + 1 + (len(bare_form.encode()) + 1 if (bare_form := bald(s)) != s else 0)
                if size >= limit:
                    break
        if size >= limit:
            break
    kept.reverse()
    return "\n".join([b for s in kept if (b := bald(s)) != s] + kept).encode()[-limit:]


@F.pandas_udf(StructType([StructField("half", IntegerType()), StructField("sentences", ArrayType(StringType()))]))
def _sample(texts: pd.Series) -> pd.DataFrame:
    """The half a text falls into and its first SAMPLE_PARTS sentences, folded."""
    cut = [[s for a, b in parts(t)[:SAMPLE_PARTS] if len(s := fold(bare(t[a:b]))) >= 12] for t in texts]
    return pd.DataFrame({"half": [hash_bit(t) for t in texts], "sentences": cut})


def fit(texts: DataFrame, sample: int = SAMPLE_TEXTS, rounds: int = 3) -> Classifier:
    """Dictionaries from about ``sample`` labelled texts of each language that has at least 3.

    Wrong labels: the sample is split in halves, each half is classified with
    the other's dictionaries, and only texts that get their label back as a
    whole go into the next round's, without sentences of another language.
    """
    labelled = texts.select("id", "text", code(F.col("language")).alias("lang")).where("lang is not null and text is not null and id is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("language"), "id"), F.lit(1 << 30)) < share * float(1 << 30)
    halves: list[dict[str, list[list[str]]]] = [{}, {}]
    # texts are cut where they lie; at most sample x SAMPLE_PARTS sentences a language come here
    drawn = labelled.where(draw).select("id", "lang", _sample("text").alias("s")).collect()
    for r in sorted(drawn, key=lambda r: (r["id"], r["s"]["sentences"])):
        if r["s"]["sentences"]:
            halves[r["s"]["half"]].setdefault(r["lang"], []).append(list(r["s"]["sentences"]))
    langs = sorted(k for k in set(halves[0]) & set(halves[1]) if counts[k] >= 3)
    kept = [{k: [s for t in h[k] for s in t] for k in langs} for h in halves]
    for _ in range(rounds):
        made = [Classifier({k: d for k in langs if (d := _dictionary(h[k]))}) for h in kept]
        if min(len(m.codes) for m in made) < 2:
            break
        kept = [{k: [s for t in h[k] if other.backs(t, k) for s in t if other.backs([s], k)] for k in langs} for h, other in zip(halves, reversed(made))]
    both = {k: [s for pair in zip_longest(kept[0][k], kept[1][k]) for s in pair if s] for k in langs}
    return Classifier({k: d for k in langs if (d := _dictionary(both[k]))})


def zip_longest(a, b):
    """Pairs of both lists in turn, None where one has ended."""
    n = max(len(a), len(b))
    return zip(a + [None] * (n - len(a)), b + [None] * (n - len(b)))


def hash_bit(text: str) -> int:
    """A bit of a text that does not depend on the process."""
    import zlib

    return zlib.crc32(text.encode()) & 1


def segments_of(text: str, classifier: Classifier) -> list[tuple[int, int, str | None, float, int, bool]]:
    """(start, end, language, confidence, words, sentence) of a text's parts, neighbours of one language joined.

    ``sentence`` tells whether a part has a whole sentence; titles, names and
    list entries are none.
    """
    found = []
    for a, b in parts(text):
        piece = fold(bare(text[a:b]))
        words = _words(piece)
        lang, sure, margin = classifier.best(piece) if len(piece) >= 8 and words >= 2 else (None, 0.0, 0.0)
        whole = lang is not None and words >= 2 and (bool(_END.search(text[a:b])) or words >= UNPUNCTUATED_WORDS)
        found.append((a, b, lang, sure, words, margin, whole))
    if found and not any(f[2] for f in found):
        # no part decides alone: the text as a whole may
        piece = fold(bare(text))
        if piece:
            lang, sure, margin = classifier.best(piece)
            return [(0, len(text), lang, sure if lang else 0.0, _words(piece), False)]
    out: list[list] = []
    for a, b, lang, sure, words, margin, whole in found:
        # a weak part takes the language around it
        weak = lang is None or (words < 4 and margin < 8)
        if out and (lang == out[-1][2] or weak):
            own = lang == out[-1][2]
            out[-1][1], out[-1][4] = b, out[-1][4] + words
            out[-1][3], out[-1][5] = (max(out[-1][3], sure), out[-1][5] or whole) if own else out[-1][3:6:2]
        elif out and out[-1][2] is None:
            out[-1] = [out[-1][0], b, lang, sure, out[-1][4] + words, whole]
        else:
            out.append([a, b, lang, sure, words, whole])
    return [tuple(o) for o in out]


def segments(texts: DataFrame, classifier: Classifier) -> DataFrame:
    """(id, language_label, part, start, end, language, confidence, words, sentence): every part of every text.

    Null, empty and wordless texts have no parts; a part that can't be decided
    has a null language. Offsets count characters. Repeated rows give their
    parts once.
    """
    shared = texts.sparkSession.sparkContext.broadcast(classifier)
    kinds = "id long, label string, part int, start int, end int, language string, confidence double, words int, sentence boolean"

    def run(batches):
        for batch in batches:
            rows = []
            for i, label, text in zip(batch["id"], batch["label"], batch["text"]):
                if not isinstance(text, str) or not _WORD.search(text):
                    continue
                rows += [(i, label, n, *part) for n, part in enumerate(segments_of(text, shared.value))]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "label", "part", "start", "end", "language", "confidence", "words", "sentence"])

    source = texts.where("id is not null").select(F.col("id").cast("long"), F.col("language").alias("label"), "text")
    # repeated rows are dropped by their parts, which are smaller than texts
    return source.mapInPandas(run, kinds).distinct()


def p2_found(texts: DataFrame) -> DataFrame:
    """(id, language) of texts with a missing or wrong label or of several languages."""
    found = segments(texts, fit(texts)).where("language is not null")
    per = found.groupBy("id", "label").agg(
        F.collect_set(F.when(F.col("sentence"), F.col("language"))).alias("whole"), F.collect_set(F.when(F.col("words") >= 3, F.col("language"))).alias("any")
    )
    # a text without any whole sentence still has the language of its words
    per = per.select("id", "label", F.when(F.size("whole") > 0, F.col("whole")).otherwise(F.col("any")).alias("languages")).where(F.size("languages") > 0)
    right = code(F.col("label"))
    wrong = right.isNull() | ~F.array_contains("languages", F.coalesce(right, F.lit(""))) | (F.size("languages") > 1)
    return per.where(wrong).select("id", F.explode("languages").alias("language")).distinct()


def p2_segments(texts: DataFrame) -> DataFrame:
    """Every part of every text with its language and confidence."""
    return segments(texts, fit(texts))


def p2_labels(texts: DataFrame) -> DataFrame:
    """(id, language, language_confidence, languages): the language with most words of each text."""
    found = segments(texts, fit(texts)).where("language is not null")
    by = found.groupBy("id", "language").agg(F.sum("words").alias("words"), F.max("confidence").alias("confidence"))
    return by.groupBy("id").agg(
        F.max_by("language", F.struct("words", "confidence", "language")).alias("language"),
        F.max_by("confidence", F.struct("words", "confidence", "language")).alias("language_confidence"),
        F.sort_array(F.collect_list("language")).alias("languages"),
    )
