import random

from catalore.llm.chunking import cut, p8_found, pieces
from catalore.llm.tokens import encoding

random.seed(4)
WORDS = "the archivist keeps a box of postcards in cellar near window while museum sorts labels under another name".split()


def sentence():
    return " ".join(random.choices(WORDS, k=random.randint(4, 14))).capitalize() + "."


TEXT = "\n\n".join(" ".join(sentence() for _ in range(random.randint(2, 9))) for _ in range(300))
count = lambda t: len(encoding().encode_ordinary(t))


def check(text, limit, overlap):
    found = cut(text, limit, overlap)
    assert "".join(text[new:end] for _, new, end, _ in found) == text
    assert all(count(text[s:e]) == n <= limit for s, _, e, n in found)
    assert all(s <= new < e for s, new, e, _ in found)
    return found


def test_cover_limit_overlap_and_boundaries():
    found = check(TEXT, 2000, 100)
    assert len(found) > 3
    assert all(80 <= count(TEXT[s:new]) <= 130 for s, new, _, _ in found[1:])
    assert all(TEXT[new - 1].isspace() for _, new, _, _ in found[1:])
    ends = sum(TEXT[:new].rstrip()[-1] == "." for _, new, _, _ in found[1:])
    assert ends >= 0.9 * (len(found) - 1)


def test_edits_change_neighbours_only():
    middle = len(TEXT) // 2
    edited = TEXT[:middle] + " some words were put in here " + TEXT[middle:]
    before, after = ({t[n:e] for _, n, e, _ in cut(t)} for t in (TEXT, edited))
    assert len(before - after) <= 3


def test_texts_without_boundaries():
    check("x" * 20000, 500, 50)
    check("".join(random.choices("abcdefgh0123456789+/", k=30000)), 1000, 100)
    check("日本語の文章です。" * 2000, 1000, 100)
    check("\n" * 9000 + "end", 300, 20)
    check("🙂" * 3000, 300, 30)
    check("a b " * 3000, 120, 0)


def test_small_and_empty():
    assert cut("") == [] and cut("few words") == [(0, 0, 9, 3)]


def test_pieces(spark):
    rows = [(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (5, "word " * 2001, "x"), (6, "word " * 1990, "x"), (None, "word " * 2500, "x"), (7, TEXT[:15000], "x"), (7, TEXT[:15000], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = pieces(docs).collect()
    assert all(r.n_tokens <= 2000 and count(r.text) == r.n_tokens for r in got)
    assert sorted((r.doc_id or -1) for r in p8_found(docs).collect()) == [-1, 1, 5, 7, 7]
    assert pieces(docs.limit(0)).count() == 0
