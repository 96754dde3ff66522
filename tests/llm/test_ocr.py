import numpy as np

from catalore.llm import ocr

SENTENCES = ["The archivist describes the winter album near the window", "Every visitor compares the longest recording with great patience", "The museum keeps the handwritten labels in the cellar", "A volunteer will replace the camera before the next scan"]


def page(i, body=None, header="The Heavy Cabinet", number=True):
    lines = [header] if header else []
    lines += body or [SENTENCES[(i + k) % 4] + "." for k in range(4)]
    return "\n".join(lines + ([f"- {i + 5} -"] if number else []))


def tables(spark, texts):
    setters = spark.createDataFrame([(1, "ocr/one"), (2, "asr/two")], "id long, name string")
    data = spark.createDataFrame([(i, item, None, setter, "text", idx, None, True, False, "x") for i, (item, setter, idx, _) in enumerate(texts)], "id long, item_id long, job_id long, setter_id long, data_type string, idx long, source_id long, is_origin boolean, is_placeholder boolean, text string")
    rows = spark.createDataFrame([(i, None, None, None, t, None) for i, (*_, t) in enumerate(texts)], "id long, language string, language_confidence double, confidence double, text string, text_length long")
    return rows, data, setters


def test_kinds_and_repair(spark):
    texts = [(1, 1, i, page(i)) for i in range(12)]
    own = len(texts)
    texts += [
        (2, 1, 0, page(0, ["Our scanner measured the win-", "ter album under a dif¬", "ferent name."], header=None, number=False)),
        (2, 1, 1, page(1, ["The archivist describes the wintcr album.", "The c@mera keeps the labels."], header=None, number=False)),
        (2, 1, 2, page(2, ["A Heading of Its Own", "", "Every visitor compares 1987 labels.", "1987"], header=None, number=False) + "\nThe museum keeps the labels in the cellar."),
        (3, 1, 0, page(0, header="The Rusty Compass   9", number=False)),
        (4, 2, 0, page(0)),
        (5, 1, None, None),
        (5, 1, 0, ""),
        (6, 1, None, " ".join(SENTENCES) * 200),
        (None, 1, 0, page(0, header=None, number=False)),
    ]
    got = {r.id: r for r in ocr.p4_pages(*tables(spark, texts)).collect()}
    kinds = {i: set(r.kinds) for i, r in got.items()}
    assert all(kinds[i] == {"header", "page_number"} for i in range(12))
    assert kinds[own] == {"hyphenation"} and "winter album under a different name." in got[own].text
    assert kinds[own + 1] == {"misread"} and "winter album" in got[own + 1].text and "camera" in got[own + 1].text
    assert kinds[own + 2] == set() and got[own + 2].text == texts[own + 2][3]
    assert kinds[own + 3] == {"header", "page_number"}
    assert own + 4 not in got and own + 5 not in got and own + 6 not in got
    assert kinds[own + 7] == set() and kinds[own + 8] == set()
    found = {(r.id, r.kind) for r in ocr.p4_found(*tables(spark, texts)).collect()}
    assert found == {(i, k) for i, ks in kinds.items() for k in ks}


def test_empty(spark):
    assert ocr.p4_found(*[t.limit(0) for t in tables(spark, [(1, 1, 0, "x y z")])]).count() == 0


def test_plausible():
    assert ocr.plausible("wintcr", "winter") and ocr.plausible("rnuseum", "museum") and ocr.plausible("6leknade", "bleknade") and ocr.plausible("tumo", "turno")
    assert not ocr.plausible("marlo", "mano") and not ocr.plausible("ilsta", "lista") and not ocr.plausible("house", "mouse")


def test_page_numbers():
    good = {"- 12 -": 12, "— 88 —": 88, "[9]": 9, "Page 9 / 20": 9, "Seite 141": 141, ". 17": 17, "88 |": 88, "xvii": 17, "iv": 4, "42": 42}
    assert {k: ocr.line_number(k)[0] for k in good} == good
    assert all(ocr.line_number(x) is None for x in ("838).", "Vegri ..... 5", "In 1987", "name.", "(12)", "Wyberpe ...... 102"))


def test_reflow_keeps_lists_and_headings():
    text = ["A Heading", "", "One long line of text that goes on to the very", "end of it. And more of", "Entry ..... 5", "Entry ..... 9"]
    assert ocr.reflow(text) == "A Heading\n\nOne long line of text that goes on to the very end of it. And more of\nEntry ..... 5\nEntry ..... 9"


def test_numbers_are_no_misread_words(spark):
    body = [f"The archivist keeps los ({i}05) and 105 labels of {i}." for i in range(1, 5)]
    texts = [(i, 1, 0, page(i, body, header=None, number=False)) for i in range(10)]
    assert all(not r.kinds for r in ocr.p4_pages(*tables(spark, texts)).collect())


def test_context_decides():
    vectors = {w: np.array(v, dtype=np.float32) for w, v in {"modern": (1, 0), "house": (0.9, 0.4), "street": (0.8, 0.6), "cable": (0, 1), "plug": (-0.1, 1)}.items()}
    links = [{"word": "modem", "neighbour": "modern", "n": 2, "often": 400}]
    assert ocr.corrections("house modem street", links, vectors, ocr.AGREE) == {(6, 11): "modern"}
    assert ocr.corrections("cable modem plug", links, vectors, ocr.AGREE) == {}


def test_every_neighbour_has_a_vector(spark):
    names = ["".join("abcdefghij"[int(c)] for c in f"{i:05d}") for i in range(20_100)]
    texts = [(1, 1, k, " ".join(names[at : at + 300])) for k in range(ocr.LEAST) for at in range(0, len(names), 300)]
    assert set(ocr.Repair(ocr.pages_of(*tables(spark, texts))).vectors) == set(names)


class NoVectors(ocr.Repair):
    def _vectors(self, words, least):
        return {}


def ambiguous(n=60):
    """Pages about a farm and pages about a kitchen; ``bam`` may be a barn or ham."""
    import random

    draw = random.Random(3)
    farm = "farmer tractor muddy field oats cattle fence stable plough hay barn".split()
    food = "cook mustard plate bread butter oven slices salted kitchen pepper ham".split()
    say = lambda words: " ".join(draw.choice(words) for _ in range(60))
    pages = [(k, 1, 0, say(w)) for k in range(n) for w in (farm, food)]
    pages += [(900, 1, 0, "tractor muddy field oats cattle bam stable plough hay fence farmer"), (901, 1, 0, "cook mustard plate bread butter bam slices salted kitchen pepper oven")]
    return pages, len(pages) - 2


def test_vectors_choose_among_plausible_words(spark):
    texts, at = ambiguous()
    pages = ocr.pages_of(*tables(spark, texts))
    fitted = ocr.Repair(pages)
    got = {r.id: (r.text, r.kinds) for r in fitted.pages().where(f"id >= {at}").collect()}
    assert "cattle barn stable" in got[at][0] and "butter ham slices" in got[at + 1][0]
    assert got[at][1] == got[at + 1][1] == ["misread"]
    assert {(r.word, r.neighbour) for r in fitted.links.collect()} == {("bam", "barn"), ("bam", "ham")}
    # without the vectors nothing is corrected
    without = {r.id: (r.text, r.kinds) for r in NoVectors(pages).pages().where(f"id >= {at}").collect()}
    assert without == {at: (texts[at][3], []), at + 1: (texts[at + 1][3], [])}


def test_far_neighbours_are_no_links(spark):
    texts, at = ambiguous()
    texts = [t for t in texts[:at] if " ham" in t[3] or "cook" in t[3]] + texts[at : at + 1] + texts[:at:2]
    pages = ocr.pages_of(*tables(spark, [(a, b, c, t.replace("barn", "shed")) for a, b, c, t in texts]))
    fitted = ocr.Repair(pages)
    # ham is plausible for bam, but stands in other company
    assert {r.neighbour for r in fitted.candidates.collect()} == {"ham"} and fitted.links.count() == 0
    assert all("misread" not in r.kinds for r in fitted.pages().collect())


def test_joins_beyond_the_broadcast_bound_give_the_same(spark):
    texts, _ = ambiguous(20)
    pages = ocr.pages_of(*tables(spark, texts))
    fitted = ocr.Repair(pages)
    rows = lambda df: sorted((*map(str, r),) for r in df.collect())
    seen, links, fixed = rows(fitted.seen), rows(fitted.links), rows(fitted.pages())
    fitted.broadcast_rows = 0
    fitted.seen = fitted._contexts()
    fitted.links = fitted._near()
    assert rows(fitted.seen) == seen and rows(fitted.links) == links and rows(fitted.pages()) == fixed


def test_depth_and_misreadings_are_parameters(spark):
    tall = lambda i: "\n".join(["The Heavy Cabinet", "Volume Seven", "County Archive", *[SENTENCES[(i + k) % 4] + "." for k in range(4)]])
    pages = ocr.pages_of(*tables(spark, [(1, 1, i, tall(i)) for i in range(6)]))
    left = lambda depth: {r.text.split("\n")[0].split(" ")[0] for r in ocr.Repair(pages, depth=depth).pages().collect()}
    assert left(2) == {"County"} and "County" not in left(3) and left(None) == left(3)
    assert not ocr.plausible("rnurnrnurns", "mummums") and ocr.plausible("rnurnrnurns", "mummums", None)
    assert [ocr.edges("a\n\nb\nc", d)[1:] for d in (2, None)] == [([0, 2], [3]), ([0, 2, 3], [])]


def test_a_very_long_word(spark):
    long = "m" * 5000
    texts = [(1, 1, i, f"the {long} stands here") for i in range(30)] + [(1, 1, 31, f"the {long[:-1]}rn stands here")]
    fitted = ocr.Repair(ocr.pages_of(*tables(spark, texts)))
    assert [(len(r.word), len(r.neighbour), r.n, r.often) for r in fitted.candidates.collect()] == [(5001, 5000, 1, 30)]
    assert fitted.pages().count() == 31
