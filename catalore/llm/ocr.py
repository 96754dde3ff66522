"""Problem 4: page texts of scanned items repaired into continuous paragraphs.

Skip-gram vectors (Spark's Word2Vec) are learnt over all page texts for every
word that occurs ``LEAST`` times. A rare word has none of its own worth having;
its vector is the mean of the vectors around all its occurrences. Its
candidates are the frequent words that a plausible glyph edit (rn and m, cl and
d, 0 and o ...) turns it into, found by an equi-join on glyph skeletons, and
those that are near it in vector space are its links. A word is corrected to
the link that fits best where it stands, and left alone where none does.
Page furniture is what repeats over an item's pages: running headers by the
skeleton of their line, page numbers by a constant distance to the page's
position. Last, broken words and wrapped lines are joined.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, StringType

from catalore.plans.runtime import cut_lineage, few

#: A neighbour is this often as frequent as the rare word at least, and occurs LEAST times.
TIMES, LEAST = 6, 4
#: The same for words of two letters.
SHORT_TIMES = 1000
#: Cosine from which a neighbour is near a word, over all its occurrences and again where it stands;
#: most frequent words drawn at random are below it, hardly any that stand there.
AGREE = 0.15
#: Words on either side that count as context, and numbers in a vector.
AROUND, SIZE = 5, 24
#: Misreadings in one word at most, None for any number; a word is not rewritten beyond recognition.
MISREADINGS = 3
#: Lines from a page's edge that may be furniture, None for all; furniture ends at the first line that is none.
EDGE_LINES = 2
#: Tokens that one training task reads; more data is more tasks.
TASK_TOKENS = 1 << 20
#: Words or links that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000

#: Glyphs (groups) that print alike, each rewritten to the right side, in this order.
GLYPHS = (("@", "a"), ("0", "o"), ("†", "t"), ("5", "s"), ("$", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("h", "b"), ("e", "c"), ("d", "cl"), ("m", "rn"), ("n", "ri"), ("u", "ii"), ("1", "l"), ("|", "l"), ("i", "l"))
#: Single misreadings (read, printed); i and l count double.
MISREAD = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("c", "e"), ("e", "c"), ("h", "b"), ("b", "h"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("0", "o"), ("5", "s"), ("$", "s"), ("6", "b"), ("6", "e"), ("6", "o"), ("8", "b"), ("9", "g"), ("@", "a"), ("†", "t"), ("i", "l"), ("l", "i"))
#: Words for page before a page number.
PAGE_WORDS = "page|seite|página|pagina|strona|bladzijde|blz|sida|pág|pag|str|p|s|с|стр|страница|ページ|頁"

_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑¬\xad][ \t]*\n\s*(?=[^\W\d_])")
_HYPHENS = ("-", "‐", "‑", "¬", "\xad")
_BREAK_END = re.compile(r"[^\W\d_][-‐‑¬\xad]\s*$")
_TOKEN = re.compile(r"[^\W_](?:[\w@†$´|]|['’](?=[\w@†$]))*|[@†$](?:[\w@†$´|])+")
_ODD = re.compile(r"[@†$´|\d]")
_ROMAN = re.compile(r"^(?=[ivxlc])(c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$", re.I)
_NUMBER = r"(?P<n>\d{1,4}|[ivxlcIVXLC]{1,8})"
_LINE_NUMBER = re.compile(
    rf"^\s*(?:(?:{PAGE_WORDS})\.?\s*{_NUMBER.replace('?P<n>', '?P<a>')}(?:\s*(?:/|of|von|de|di|van|av|z|из)\s*\d+)?|[-–—]\s*{_NUMBER.replace('?P<n>', '?P<b>')}\s*[-–—]|\[\s*{_NUMBER.replace('?P<n>', '?P<c>')}\s*\]|[.|·]\s*{_NUMBER.replace('?P<n>', '?P<d>')}|{_NUMBER.replace('?P<n>', '?P<e>')}\s*[|·]?|{_NUMBER.replace('?P<n>', '?P<f>')}\s*/\s*\d+)\s*$",
    re.I,
)
_WITH_NUMBER = re.compile(r"^\s*(?:(?P<n1>\d{1,4})\s{2,}(?P<t1>\S.*?)|(?P<t2>\S.*?)\s{2,}(?P<n2>\d{1,4}))\s*$")
FAR = 1 << 30
_PAIRS = "page long, item long, setter long, edge string, key long, shift long"


def skeleton(word: str) -> str:
    """What a word looks like when printed badly."""
    word = unicodedata.normalize("NFKD", word.lower().replace("´", ""))
    word = "".join(c for c in word if not unicodedata.combining(c))
    for glyph, like in GLYPHS:
        word = word.replace(glyph, like)
    return word


def plausible(read: str, printed: str, most: int | None = MISREADINGS) -> bool:
    """Whether ``read`` comes from ``printed`` by at most ``most`` single misreadings (accents are one each)."""
    most = 2 * len(read) if most is None else most
    plain = lambda w: "".join(c for c in unicodedata.normalize("NFKD", w.lower().replace("´", "")) if not unicodedata.combining(c))
    a, b = plain(read), plain(printed)
    if a == b:
        return read != printed
    known: dict[tuple[int, int], int] = {(0, 0): 0}
    reach = most + 1  # a misreading shifts by one letter at most
    for i in range(len(a) + 1):
        for j in range(max(0, i - reach), min(len(b), i + reach) + 1):
            at = known.get((i, j))
            if at is None or at > most:
                continue
            if i < len(a) and j < len(b) and a[i] == b[j]:
                known[(i + 1, j + 1)] = min(at, known.get((i + 1, j + 1), FAR))
            for wrong, right in MISREAD:
                if a.startswith(wrong, i) and b.startswith(right, j):
                    to, cost = (i + len(wrong), j + len(right)), at + (2 if wrong + right in ("il", "li") else 1)
                    known[to] = min(cost, known.get(to, FAR))
    return known.get((len(a), len(b)), FAR) <= most


def _roman(text: str):
    if not text or not _ROMAN.match(text):
        return None
    value, last = 0, 0
    for c in reversed(text.lower()):
        v = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c]
        value, last = (value - v, last) if v < last else (value + v, v)
    return value


def line_number(line: str):
    """(value, plain) of a line that holds a page number alone, else None; plain: without any mark."""
    m = _LINE_NUMBER.match(line)
    if not m:
        return None
    text = next(v for v in m.groups() if v)
    value = int(text) if text.isdigit() else _roman(text)
    if value is None:
        return None
    return value, bool(m["e"]) and "|" not in line and "·" not in line


def edges(text: str, depth: int | None = EDGE_LINES):
    """(lines, numbers of the first ``depth`` that are not blank, and of the last, none in both)."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    depth = len(full) if depth is None else depth
    return lines, full[:depth], full[max(depth, len(full) - depth) :]


def title(line: str) -> bool:
    """Whether a line may be a running title: short and not a sentence's end or middle."""
    bare = line.strip()
    return 3 <= len(bare) <= 80 and not re.search(r"[.!?…,;:]$", bare) and bare[:1].isalnum() and bool(re.search(r"[^\W\d_]{2}", bare))


def line_key(line: str) -> int:
    """64 bits that stand for a line's skeleton among the lines of its item."""
    return int.from_bytes(hashlib.blake2b(" ".join(skeleton(line).split()).encode(), digest_size=8).digest(), "big", signed=True)


def _edge_rows(depth):
    def run(batches):
        for batch in batches:
            rows = []
            for page, item, setter, idx, text in zip(batch["id"], batch["item_id"], batch["setter_id"], batch["idx"], batch["text"]):
                lines, top, bottom = edges(text, depth)
                own = [(page, item, setter, "page", 0, 0)]
                for i in [*top, *bottom]:
                    line = lines[i]
                    if (n := line_number(line)) is not None:
                        own.append((page, item, setter, "number", 0, n[0] - idx))
                        continue
                    m = _WITH_NUMBER.match(line)
                    if m and title(m["t1"] or m["t2"]):
                        own.append((page, item, setter, "number", 0, int(m["n1"] or m["n2"]) - idx))
                        line = m["t1"] or m["t2"]
                    if title(line) and len(lines) > 1:
                        own.append((page, item, setter, "title", line_key(line), 0))
                rows += dict.fromkeys(own)  # each once a page
            yield pd.DataFrame(rows, columns=["page", "item", "setter", "edge", "key", "shift"])

    return run


def pages_of(extracted_text: DataFrame, item_data: DataFrame, setters: DataFrame, readers: str = "ocr/") -> DataFrame:
    """(id, item_id, setter_id, idx, text) of the page texts of scanned items, each id once.

    Null and empty texts are no pages; a page without position counts as the first.
    """
    made = item_data.join(F.broadcast(setters.where(F.col("name").startswith(readers)).select(F.col("id").alias("setter_id"))), "setter_id")
    rows = extracted_text.where(F.length(F.trim("text")) > 0).select("id", "text").join(made.select("id", "item_id", "setter_id", "idx"), "id")
    return rows.groupBy("id").agg(F.first("item_id").alias("item_id"), F.first("setter_id").alias("setter_id"), F.coalesce(F.first("idx"), F.lit(0)).alias("idx"), F.max("text").alias("text"))


@F.pandas_udf(ArrayType(StringType()))
def _tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _TOKEN.findall(_BROKEN.sub("", t.lower())))


@F.pandas_udf(StringType())
def _skeleton(words: pd.Series) -> pd.Series:
    return words.map(skeleton)


@F.pandas_udf(ArrayType(StringType()))
def _skeletons(words: pd.Series) -> pd.Series:
    """All skeletons of a word; a 6 may stand for three letters."""
    return words.map(lambda w: sorted({skeleton(w.replace("6", c)) for c in "6eo"}))


def _plausible(read, printed, most):
    @F.pandas_udf(BooleanType())
    def run(read: pd.Series, printed: pd.Series) -> pd.Series:
        return pd.Series([plausible(a, b, most) for a, b in zip(read, printed)], dtype=bool)

    return run(read, printed)


def context(words: list[str], at: int, vectors) -> np.ndarray | None:
    """The summed vectors around a word, None where no word around it has one."""
    around = [vectors[w] for w in words[max(0, at - AROUND) : at] + words[at + 1 : at + AROUND + 1] if w in vectors]
    return np.sum(around, axis=0) if around else None


def fit(mean: np.ndarray | None, vector: np.ndarray | None) -> float:
    """Cosine of a context and a word's vector; 0 where either is missing."""
    return float(mean @ vector) / max(float(np.linalg.norm(mean)), 1e-9) if mean is not None and vector is not None else 0.0


class Repair:
    """Fits vectors, links and furniture over all pages; ``pages()`` gives the repaired texts.

    ``links`` holds (word, neighbour, n, often, near) for every rare word.
    """

    def __init__(self, pages: DataFrame, times: float = TIMES, least: int = LEAST, agree: float = AGREE, most: int | None = MISREADINGS, depth: int | None = EDGE_LINES, broadcast_rows: int = BROADCAST_ROWS):
        self.spark = pages.sparkSession
        self.agree, self.depth, self.broadcast_rows = agree, depth, broadcast_rows
        self.source = cut_lineage(pages.withColumn("tokens", _tokens("text")))
        words = self.source.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        self.words = words = cut_lineage(words.withColumn("skeleton", _skeleton("word")))
        self.vectors = self._vectors(words, least)
        sound = words.where((F.col("n") >= least) & ~F.col("word").rlike(r"[@†$´|\d]")).select("skeleton", F.col("word").alias("neighbour"), F.col("n").alias("often"))
        # two letters are a misread word only if they look it, or against an overwhelming neighbour
        # a number is no word
        rare = words.where((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}")).select(F.explode(_skeletons("word")).alias("skeleton"), "word", "n")
        found = rare.join(sound, "skeleton").where((F.col("word") != F.col("neighbour")) & (F.col("often") >= times * F.col("n")))
        sure = (F.length("word") >= 3) | F.col("word").rlike(r"[@†$´|\d]") | ((F.col("often") >= SHORT_TIMES * F.col("n")) & ~F.col("word").rlike("^[ivxlc]+$"))
        self.candidates = cut_lineage(found.where(sure).where(_plausible(F.col("word"), F.col("neighbour"), most)).select("word", "neighbour", "n", "often").distinct())
        self.seen = cut_lineage(self._contexts())
        self.links = cut_lineage(self._near())

    def _vectors(self, words: DataFrame, least: int) -> dict[str, np.ndarray]:
        """Unit vectors of all words that can be a neighbour, trained over all pages in as many tasks as they need."""
        size = words.where(F.col("n") >= least).agg(F.count(F.lit(1)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
        if size["words"] < 2:
            return {}
        tasks = max(6, -(-size["tokens"] // TASK_TOKENS))
        model = Word2Vec(vectorSize=SIZE, windowSize=4, minCount=least, maxIter=1, numPartitions=tasks, stepSize=0.05, seed=11, inputCol="tokens", outputCol="v", maxSentenceLength=10_000).fit(self.source.select("tokens"))
        out = {}
        for r in model.getVectors().toLocalIterator():
            v = r["vector"].toArray().astype(np.float32)
            out[r["word"]] = v / max(float(np.linalg.norm(v)), 1e-9)
        return out

    def _contexts(self) -> DataFrame:
        """(id, word, sum): where words with candidates stand, and the vectors around them there."""
        names = self.candidates.select("word").distinct()
        shared = self.spark.sparkContext.broadcast(self.vectors)
        if few(names, self.broadcast_rows):
            known = self.spark.sparkContext.broadcast({r["word"] for r in names.collect()})  # checked above
            source = self.source.select("id", "tokens", F.lit(None).cast("array<string>").alias("own"))
        else:
            known = None
            own = self.source.select("id", F.explode(F.array_distinct("tokens")).alias("word")).join(names, "word").groupBy("id").agg(F.collect_list("word").alias("own"))
            source = self.source.select("id", "tokens").join(own, "id")

        def run(batches):
            for batch in batches:
                rows = []
                for i, tokens, own in zip(batch["id"], batch["tokens"], batch["own"]):
                    wanted = known.value if known is not None else set(own)
                    sums: dict[str, np.ndarray] = {}
                    words = list(tokens)
                    for at, word in enumerate(words):
                        if word in wanted:
                            mean = context(words, at, shared.value)
                            sums[word] = sums.get(word, 0.0) + (np.zeros(SIZE, np.float32) if mean is None else mean)
                    rows += [(i, w, v.astype(np.float32)) for w, v in sums.items()]
                yield pd.DataFrame(rows, columns=["id", "word", "sum"])

        return source.mapInPandas(run, "id long, word string, sum array<float>")

    def _near(self) -> DataFrame:
        """The candidates near their word: where they are above ``agree`` on all its occurrences together.

        A word with a glyph that words don't have is misread whatever stands
        around it; its candidates all stay.
        """
        total = self.seen.groupBy("word").agg(*[F.sum(F.element_at("sum", i + 1)).alias(f"_{i}") for i in range(SIZE)])
        both = self.candidates.join(total.select("word", F.array(*[f"_{i}" for i in range(SIZE)]).alias("sum")), "word")
        shared = self.spark.sparkContext.broadcast(self.vectors)

        @F.pandas_udf(DoubleType())
        def near(sums: pd.Series, words: pd.Series) -> pd.Series:
            return pd.Series([fit(np.asarray(s), shared.value.get(w)) for s, w in zip(sums, words)], dtype=float)

        odd = F.col("word").rlike(r"[@†$´|\d]")
        return both.withColumn("near", near("sum", "neighbour")).where(odd | (F.col("near") >= self.agree)).drop("sum")

    def furniture(self) -> DataFrame:
        """(id, headers, shifts, siblings): per page its item's confirmed headers (as ``line_key``), page-number shifts and pages."""
        seen = cut_lineage(self.source.select("id", "item_id", "setter_id", "idx", "text").mapInPandas(_edge_rows(self.depth), _PAIRS).where("item is not null"))
        counted = seen.groupBy("item", "setter", "edge", "key", "shift").agg(F.count(F.lit(1)).alias("pages"))
        agreed = counted.where("pages > 1")
        return (
            seen.join(agreed, ["item", "setter", "edge", "key", "shift"])
            .groupBy(F.col("page").alias("id"))
            .agg(F.collect_set(F.when(F.col("edge") == "title", F.col("key"))).alias("headers"), F.collect_set(F.when(F.col("edge") == "number", F.col("shift"))).alias("shifts"), F.max(F.when(F.col("edge") == "page", F.col("pages"))).alias("siblings"))
        )

    def pages(self) -> DataFrame:
        """(id, text, kinds, fixes): repaired text, kinds of damage found, number of words corrected."""
        links = F.broadcast(self.links) if few(self.links, self.broadcast_rows) else self.links
        linked = self.seen.select("id", "word").join(links, "word").groupBy("id").agg(F.collect_list(F.struct("word", "neighbour", "n", "often")).alias("links"))
        whole = self.source.select("id", "idx", "text").join(self.furniture(), "id", "left").join(linked, "id", "left")
        shared, agree, depth = self.spark.sparkContext.broadcast(self.vectors), self.agree, self.depth

        def run(batches):
            for batch in batches:
                rows = []
                for i, idx, text, headers, shifts, siblings, links in zip(*[batch[c] for c in ("id", "idx", "text", "headers", "shifts", "siblings", "links")]):
                    rows.append((i, *repair(text, int(idx), {int(h) for h in headers} if headers is not None else set(), {int(s) for s in shifts} if shifts is not None else set(), not siblings > 2, links if links is not None else [], shared.value, agree, depth)))
                yield pd.DataFrame(rows, columns=["id", "text", "kinds", "fixes"])

        return whole.mapInPandas(run, "id long, text string, kinds array<string>, fixes int")


def _like(found: str, right: str) -> str:
    """``right`` in the letter case of ``found``."""
    letters = [c for c in found if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return right.upper()
    return right[:1].upper() + right[1:] if letters and letters[0].isupper() and (found[0].isupper() or not found[0].isalpha()) else right


def corrections(text: str, links, vectors, agree: float) -> dict[tuple[int, int], str]:
    """(start, end) to right word, for the tokens of ``text`` that a link explains in their context."""
    options: dict[str, list] = {}
    for link in links:
        options.setdefault(link["word"], []).append(link)
    if not options and not _ODD.search(text):
        return {}
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    lower = [t[2].lower() for t in tokens]
    out = {}
    for at, (a, b, word) in enumerate(tokens):
        own = options.get(lower[at])
        odd = _ODD.search(word)
        if own:
            mean = context(lower, at, vectors)
            fits = [(fit(mean, vectors.get(link["neighbour"])), link) for link in own]
            best, link = max(fits, key=lambda f: (f[0] + 0.05 * float(np.log(f[1]["often"])), f[1]["neighbour"]))
            if best >= agree or odd:
                out[(a, b)] = _like(word, link["neighbour"])
                continue
        if odd and _mixed(word):
            out[(a, b)] = _letters(word)
    return out


def _mixed(word: str) -> bool:
    """Whether a word that is no known one holds glyphs that words don't have."""
    if re.fullmatch(r"0x[0-9a-fA-F]+|\d+[a-z]{1,2}|[A-Z]{1,4}\d+|[A-Za-z]?\d+", word):
        return False
    letters = sum(c.isalpha() for c in word)
    odd = len(_ODD.findall(word))
    return letters >= 3 and 0 < odd <= letters // 2 and bool(re.search(r"[^\W\d_][@†$´|\d]|[@†$|\d][^\W\d_]{2}", word))


def _letters(word: str) -> str:
    """A mixed word with its odd glyphs read as letters."""
    upper = word.isupper()
    for glyph, like in (("@", "a"), ("0", "o"), ("1", "l"), ("†", "t"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("|", "l")):
        word = word.replace(glyph, like.upper() if upper else like)
    return unicodedata.normalize("NFC", re.sub(r"(\w)´", lambda m: m[1] + "̈", word))


def repair(text: str, idx: int, headers: set, shifts: set, few: bool, links, vectors, agree: float, depth: int | None = EDGE_LINES):
    """(repaired text, kinds of damage, words corrected); a sound page comes back unchanged.

    A page-number line without any mark needs its item's sequence, or, where the
    item has too ``few`` pages for one, the outermost line of the page.
    """
    lines, top, bottom = edges(text, depth)
    kinds: set[str] = set()
    gone: set[int] = set()
    for order in (top, (bottom or top)[::-1]):
        for i in order:
            if i in gone:
                continue
            line = lines[i]
            number = line_number(line)
            if number is not None:
                if number[0] - idx in shifts or not number[1] or few and i == order[0] and number[0] < 1000:
                    kinds.add("page_number")
                    gone.add(i)
                    continue
                break
            m = _WITH_NUMBER.match(line)
            name = (m["t1"] or m["t2"]) if m and title(m["t1"] or m["t2"]) else line
            if m and name is not line:
                near = int(m["n1"] or m["n2"]) - idx in shifts
                if near or line_key(name) in headers or len(lines) > 2 and len(name.split()) <= 8 and ".." not in name:
                    kinds |= {"header", "page_number"}
                    gone.add(i)
                    continue
            if len(lines) > 1 and title(line) and line_key(line) in headers:
                kinds.add("header")
                gone.add(i)
                continue
            break
    fixes = corrections(text, links, vectors, agree)
    if fixes:
        kinds.add("misread")
    body = [i for i in range(len(lines)) if i not in gone]
    # a word broken at the end of the last line goes on overleaf
    if any(_broken(lines[i]) and (j == len(body) - 1 or lines[body[j + 1]][:1].isalpha()) for j, i in enumerate(body)):
        kinds.add("hyphenation")
    if not kinds:
        return text, [], 0
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    fixed = list(lines)
    for (a, b), right in sorted(fixes.items(), reverse=True):
        i = np.searchsorted(starts, a, side="right") - 1
        if b <= starts[i] + len(lines[i]):
            fixed[i] = fixed[i][: a - starts[i]] + right + fixed[i][b - starts[i] :]
    return reflow([fixed[i] for i in body]), sorted(kinds), len(fixes)


def _broken(line: str) -> bool:
    """Whether a line ends in the middle of a word."""
    return line.rstrip()[-1:] in _HYPHENS and bool(_BREAK_END.search(line))


def reflow(lines: list[str]) -> str:
    """Wrapped lines joined into paragraphs; blank lines, titles, lists and entries keep their lines."""
    while lines and not lines[0].strip():
        lines = lines[1:]
    while lines and not lines[-1].strip():
        lines = lines[:-1]
    width = max(map(len, lines), default=0)
    out: list[str] = []
    for i, line in enumerate(lines):
        before = lines[i - 1] if i else ""
        # the last line goes on if this one's first word would not have fitted on it
        wrapped = before.strip() and line.strip() and (_broken(before) or len(before) + 1 + len(line.split(" ", 1)[0]) > width - 1) and not re.search(r"\.{4,}\s*\d+\s*$", before)
        if not wrapped:
            out.append(line)
        elif _broken(before) and line[:1].isalpha():
            out[-1] = re.sub(r"[-‐‑¬\xad]\s*$", "", out[-1]) + line.lstrip()
        else:
            out[-1] = out[-1].rstrip() + " " + line.lstrip()
    return "\n".join(out)


def p4_found(extracted_text: DataFrame, item_data: DataFrame, setters: DataFrame) -> DataFrame:
    """(id, kind): the kinds of damage of every page text of a scanned item."""
    fixed = Repair(pages_of(extracted_text, item_data, setters)).pages()
    return fixed.select("id", F.explode("kinds").alias("kind"))


def p4_pages(extracted_text: DataFrame, item_data: DataFrame, setters: DataFrame) -> DataFrame:
    """Every page text of a scanned item, repaired."""
    return Repair(pages_of(extracted_text, item_data, setters)).pages()
