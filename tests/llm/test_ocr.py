from __future__ import annotations

from lexquarry.llm import ocr

WORDS = {w: 500 for w in "the court shall register notwithstanding cross-examination cross examination custody in safe of keep notary number during column licence and was held night-shift night shift".split()} | {"gokusund": 9, "sh": 0}
READER = ocr.Reader(ocr.Words(WORDS), ocr.Lines(["supreme court of velmora"]))


def kinds(pages, title=None):
    return {(x.page, x.no): sorted(x.kinds) for x in ocr.read(pages, title, READER) if x.kinds}


def test_numbers():
    assert [ocr._value(s) for s in ("12", "l2", "xiv", "iix", "zz", "4 6")] == [12, 12, 14, None, None, 46]


def test_furniture_on_pages():
    pages = ["Some Law Journal    [7\nthe court\nshall keep\n– 7 –", "Some Law Jornal    [8\nthe notary\n\n– 8 –", "8\nSome Law Journal    [9\nthe court\n1965.\n– 9 –"]
    got = kinds(pages)
    assert {k for k, v in got.items() if v == ["furniture"]} >= {(1, 1), (1, 4), (2, 1), (2, 4), (3, 5)}
    assert (3, 4) not in got and (1, 2) not in got


def test_furniture_known_from_the_corpus_and_the_title():
    assert kinds(["SUPREME COURT OF VEMORA\nthe court shall"]) == {(1, 1): ["furniture"]}
    assert kinds(["Coastal Quarries Act 1954\nthe court shall"], "Coastal Quarries Act 1954") == {(1, 1): ["furniture"]}
    assert kinds(["The court of the notary\nshall keep"]) == {}


def test_broken_words_across_lines_and_pages():
    assert kinds(["the court shall regi-\nster the notary"]) == {(1, 1): ["broken"]}
    assert kinds(["the court shall regi­\n\n– 3 –", "– 4 –\nster the notary"])[1, 1] == ["broken"]
    assert kinds(["keep in safe cus- \ntody of the notary notwith-\nstanding the court"]) == {(1, 1): ["broken"], (1, 2): ["broken"]}
    assert kinds(["the cross-\nexamination of the night-\nshift was held"]) == {}


def test_misread_words():
    assert kinds(["the c0urt shal1 keep", "the rcgister of gokusund", "the notary"]) == {(1, 1): ["misread"], (2, 1): ["misread"]}
    assert kinds(["shall regi-\nstcr the notary"]) == {(1, 1): ["broken"], (1, 2): ["misread"]}
    assert kinds(["gokusund 1l 5 C-2/15 12"]) == {}


def test_misread_words_of_a_large_corpus():
    reader = ocr.Reader(ocr.Words({"shall": 1_841_300, "register": 90_000, "5hall": 3_100, "sha1l": 2_600, "rcgister": 2_200, "hall": 400_000}), ocr.Lines(()))
    page = "it 5hall keep the rcgister\nin the hall 5ha1l regi-\nstcr it"
    lines = ocr.read([page], None, reader)
    assert [(x.no, sorted(x.kinds)) for x in lines] == [(1, ["misread"]), (2, ["broken", "misread"]), (3, ["misread"])]
    assert [x.fixed for x in lines] == ["it shall keep the register", "in the hall shall register", "it"]
    reader = ocr.Reader(ocr.Words({"register": 90_000, "regi": 1, "registcr": 2_200}), ocr.Lines(()))
    assert [sorted(x.kinds) for x in ocr.read(["it was to regi-\nstcr the notary"], None, reader)] == [["broken"], ["misread"]]
    assert ocr.Reader(ocr.Words({"p-6/71": 900}), ocr.Lines(())).true_word("p-8/71") is None


def test_repaired_paragraphs():
    pages = ["SUPREME COURT OF VELMORA\n    The court shall regi-\nster the licence niimber\nof the notary.\n\nThe notary was held in cus-", "safe\n7"]
    lines = ocr.read(["SUPREME COURT OF VELMORA\nThe court shall regi-\nster the niimber of the\ncross-\nexamination.\n\nThe notary was in cus-", "SUPREME COURT OF VELMORA\ntody of the court."], None, READER)
    assert ocr.paragraphs(lines) == ["The court shall register the number of the cross-examination.", "The notary was in custody of the court."]
    assert len(ocr.paragraphs(ocr.read(pages, None, READER))) == 2


def test_tables(spark):
    good = "the court shall keep the register in custody of the notary\n" * 6
    rows = [(i, None, [good, good], "x") for i in range(8)] + [(20, "t", ["the c0urt shall\nkeep the regis-\nter of it"], None), (21, None, None, None), (22, None, [], "the court\nshall"), (23, None, [None, ""], None), (20, "t", ["the c0urt shall\nkeep the regis-\nter of it"], None)]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "ord bigint, title string, pages array<string>, text string, page_no int, kind string")
    shipped = ocr.learn(docs)
    got = sorted(tuple(r) for r in ocr.noisy_lines(docs, shipped).collect() if r.ord >= 20)
    assert got == [(20, 1, 1, "misread")] * 2 + [(20, 1, 2, "broken")] * 2
    text = {(r.ord, r.paragraph_no): r.paragraph for r in ocr.readable(docs, shipped).collect() if r.ord >= 20}
    assert text == {(20, 1): "the court shall keep the register of it", (22, 1): "the court shall"}
    empty = docs.limit(0)
    assert ocr.noisy_lines(empty, ocr.learn(empty)).count() == 0


def test_a_large_vocabulary_is_whole(spark):
    """Rare words of a corpus of very many words are known: nothing is cut off at a number of words."""
    word = lambda i: "".join("bcdfghjklmnprstv"[i // 16**k % 16] + "aeiou"[i // 5**k % 5] for k in range(5))
    lines = [" ".join(word(j) for j in range(i, i + 10)) for i in range(0, 300_000, 10)]
    rows = [(i, None, ["\n".join(lines[i * 100 : i * 100 + 100])] * 3, None) for i in range(300)] + [(1000, None, [f"{word(299_994)} {word(7)[:-1]}-\n{word(7)[-1]} x"], None)]
    docs = spark.createDataFrame(rows, "ord bigint, title string, pages array<string>, text string").repartition(8)
    learnt = ocr.learn(docs)
    count = spark.range(1).mapInPandas(lambda it: (b.assign(id=len(ocr.Table(learnt.words).h), got=[str(ocr.Table(learnt.words).first([word(299_994), word(7), "none"]))]) for b in it), "id bigint, got string").first()
    assert count.id > 200_000 and count.got.endswith(" 0]") and "[0" not in count.got
    assert (1000, 1, 1, "broken") in {tuple(r) for r in ocr.noisy_lines(docs.where("ord = 1000"), learnt).collect()}


def test_edge_lines_follow_the_corpus(spark):
    said = [f"The {a} was found to have {b} the" for a in "notary valuer surveyor carrier guardian".split() for b in "altered kept moved sealed leased".split()]
    page = lambda i, k: [said[(i * 7 + k * 11 + j * (i % 9 + 1)) % 25] for j in range(20)]
    rows = [(f"d{i}", ["\n".join(["Rent Tribunal Ostwick"] * (i % 5 == 0) + page(i, k)) for k in range(2)]) for i in range(60)]
    fresh = [f"the sum of {j} florins was paid by the" for j in range(20)]
    rows += [(f"again{i % 2}", ["\n".join(["Any aggrieved person shall be heard by the", *fresh, f"copy {i}"])]) for i in range(30)]
    rows += [(f"copy{i}", ["\n".join(["The liquidator contested the validity of the", *fresh])]) for i in range(30)]
    docs = spark.createDataFrame(rows, "name string, pages array<string>")
    learnt = ocr.learn(docs)

    def shared(batches):
        lines = ocr.ShippedLines(learnt)
        for b in batches:
            yield b.assign(id=[len(lines.lines.h)], line=[lines.lines.text(0)], like=[", ".join(lines.like("the tribunal"))], has=[lines.has("rent tribunal ostwick")])

    got = spark.range(1).mapInPandas(shared, "id bigint, line string, like string, has boolean").first()
    assert tuple(got) == (1, "rent tribunal ostwick", "rent tribunal ostwick", True)
    assert ocr.edge_lines(docs.limit(0), 0.0).count() == 0
