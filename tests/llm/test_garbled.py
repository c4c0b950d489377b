from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from lodestrata.llm.garbled import SET_READ_AS, UNKNOWN, UTF8_READ_AS, Examiner, Mistakes, Page, fitted, garbled, looks_right, sampled, statistics

GERMAN = "Nach der Prüfung von PricePermitAdapter.java läuft spürbar schneller, weil der Index für voucher neu gebaut wurde."
ENGLISH = "As discussed, the layout layer isn’t covered by any view – ask Zoë or Jiří."
RUSSIAN = "Каждый изменённый файл в jarede.module требует меньшего интерфейса"
DECOYS = [
    ("en", "The export prints `Ã¼` where the author typed ü, see the attached view."),
    ("de", "In der Ausgabe steht „Ã¤“ statt „ä“, der Rest ist in Ordnung."),
    ("en", "Column header shows “Ã©” instead of “é” on the build host only."),
    ("en", "Grep for `â€™` finds 92 places in the old dump – none in this repository’s sources."),
    ("en", "The viewer draws � for bytes it can't decode; a “?” would be fine too."),
    ("en", "été (decomposed) vs été"), ("de", "½ of №87 ≈ 50‰"), ("en", "파일 57개"), ("en", "🚀 ship it 👩🏽‍💻 ✅"), ("en", "ﬁle ﬂow ﬃ"),
]


@pytest.fixture(scope="module")
def examiner(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return Examiner(fitted(docs))


@pytest.mark.parametrize("wrong", ["cp1252", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("text, lang", [(GERMAN, "de"), (ENGLISH, "en")])
def test_utf8_read_wrongly_comes_back(examiner, wrong, text, lang):
    bad = text.encode("utf-8").decode(wrong, "ignore" if wrong == "mac_roman" else "strict") if wrong != "cp1252" else sloppy(text)
    found = examiner.text(bad, lang)
    assert found and found[1] == text


def sloppy(text):
    return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode("utf-8"))


def test_twice_and_as_codes(examiner):
    assert examiner.text(sloppy(sloppy(GERMAN)), "de")[1] == GERMAN
    codes = "".join(f"&#{ord(c)};" if ord(c) > 127 else c for c in sloppy(GERMAN))
    assert examiner.text(codes, "de")[1] == GERMAN


@pytest.mark.parametrize("right, wrong", [("cp1252", "cp437"), ("cp1252", "cp1251"), ("mac_roman", "cp1252")])
def test_one_set_read_as_another(examiner, right, wrong):
    table = Mistakes().bytes[wrong]
    back = {b: c for c, b in table.items()}
    bad = "".join(back.get(c.encode(right)[0], c) if ord(c) > 127 else c for c in GERMAN)
    assert examiner.text(bad, "de")[1] == GERMAN


def test_cyrillic_and_part(examiner):
    assert examiner.text(RUSSIAN.encode("cp1251").decode("latin-1"), "ru")[1] == RUSSIAN
    mixed = f"{GERMAN}\n\n{sloppy(ENGLISH)}"
    assert examiner.text(mixed, "de")[1] == f"{GERMAN}\n\n{ENGLISH}"


def test_lost_characters_are_found_not_restored(examiner):
    found = examiner.text(GERMAN.replace("ü", UNKNOWN), "de")
    assert found and not found[2]


@pytest.mark.parametrize("lang, text", [*DECOYS, ("de", GERMAN), ("en", ENGLISH), ("ru", RUSSIAN)])
def test_right_texts_stay(examiner, lang, text):
    assert examiner.text(text, lang) is None and examiner.text(f"Plain.\n{text}\nPlain.", lang) is None


def test_frame(spark):
    columns = "doc_id long, text string, lang string, restored int"
    rows = [(1, sloppy(GERMAN), "de", 0), (2, GERMAN, "de", 0), (3, None, None, 0), (4, "", "en", 0), (5, sloppy(GERMAN), None, 0), (6, sloppy(GERMAN), "xx", 0), (1, sloppy(GERMAN), "de", 0)]
    rows += [(100 + i, GERMAN.replace("voucher", f"part{i}"), "de", 0) for i in range(60)]
    got = garbled(spark.createDataFrame(rows, columns)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 1, 5, 6] and {r["restored"] for r in got} == {GERMAN}
    assert garbled(spark.createDataFrame([], columns)).count() == 0
    assert garbled(spark.createDataFrame([(1, "plain", None, 0)], columns)).count() == 0


def read_as(text, wrong):
    """``text`` in UTF-8 with each byte read as ``wrong``; None if the set has no character for a byte."""
    back = {b: c for c, b in Mistakes().bytes[wrong].items()} | ({b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} if wrong == "cp1252" else {})
    data = text.encode("utf-8")
    return "".join(chr(b) if b < 128 else back[b] for b in data) if all(b < 128 or b in back for b in data) else None


def swapped(text, right, wrong):
    back = {b: c for c, b in Mistakes().bytes[wrong].items()}
    try:
        data = text.encode(right)
    except UnicodeEncodeError:
        return None
    return "".join(chr(b) if b < 128 else back[b] for b in data) if all(b < 128 or b in back for b in data) else None


HELD_OUT = [
    ("de", "Größere Änderungen an der Prüfung müssen vor der nächsten Auslieferung übernommen werden."),
    ("fr", "La tâche a été déplacée près de l’équipe, car la réécriture n’était pas prévue."),
    ("ru", "Новый модуль пока не работает, но каждый файл уже читается."),
    ("pl", "Każdy plik źródłowy zmieniono później, więc różnica jest mała."),
    ("en", "The author’s naïve plan – drop the café view – isn’t covered."),
]


@pytest.mark.parametrize("first", UTF8_READ_AS)
@pytest.mark.parametrize("second", UTF8_READ_AS)
def test_two_sets_one_upon_the_other(examiner, first, second):
    """Restored, or known to be beyond it: never a garbled text as the right one."""
    tried = restored = 0
    for lang, text in HELD_OUT:
        once = read_as(text, first)
        bad = once and read_as(once, second)
        if not bad:
            continue
        found = examiner.text(bad, lang)
        assert found and (found[1] == text or not found[2]), (lang, found)
        tried, restored = tried + 1, restored + (found[1] == text)
    assert restored >= tried - 1


@pytest.mark.parametrize("pair", SET_READ_AS)
def test_sets_swapped_and_read_from_utf8_after_that(examiner, pair):
    for lang, text in HELD_OUT:
        once = swapped(text, *pair)
        if not once or once == text:
            continue
        found = examiner.text(once, lang)
        assert found is None or found[1] == text or not found[2]
        if twice := read_as(once, "cp1252"):
            found = examiner.text(twice, lang)
            assert found and (found[1] == text or not found[2]), (lang, found)


def test_wide_sets(examiner):
    text = "前回の解析から次の版の前に分割するべきだ。"
    for right in ("shift_jis", "euc_jp"):
        bad = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode(right))
        assert examiner.text(bad, "ja")[1] == text


def test_every_candidate_is_compressed_once(examiner):
    """No version is left out: the bytes of each are in what was compressed."""
    compressed = []

    class Spy:
        def __init__(self, press):
            self.press = press

        def compress(self, data):
            compressed.append(data)
            return self.press.compress(data)

    spied = Examiner({})
    spied.__dict__ |= examiner.__dict__ | {"lines": {}, "press": {k: Spy(v) for k, v in examiner.press.items()}}
    text = "Für jede geänderte Datei fällt die Prüfung auf, weil sie größer ist."
    assert spied.line(text, "de")[1] == ""
    for chain in {c for w in text.split() for c in spied.chains(w) if not spied.mistakes.mixed(c)}:
        for lang in ("de", "en"):
            assert spied.page[lang].encode(spied.version(text, chain)) in compressed


def test_common_characters_side_by_side_are_no_sign():
    # these two are a sequence of UTF-8 read as mac_roman
    assert not looks_right("L’équipe", Mistakes()) and looks_right("L’équipe", Mistakes(), {"’", "é"})


def test_the_sample_is_bounded(spark):
    rows = [(i, f"{GERMAN} {i}", "de") for i in range(400)] + [(1000, "x" * 30_000, "de"), (1001, None, "de"), (1002, GERMAN, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert 20 < sampled(docs, 100).count() < 250 and sampled(docs).count() == 400 and sampled(docs.limit(0)).count() == 0


def test_characters_are_counted_over_all_texts_of_every_language(spark):
    import collections

    # more texts than the sample takes, one in 160 with a letter of its own: just above what is rare; and many languages
    texts = [("en", f"The layout layer{'’ł'[: 1 + (i % 160 == 0)]}s view {i} isn’t covered by any other – ask again.") for i in range(16_000)]
    texts += [("en", f"The layout layer’ș view {i} isn’t covered by any other – ask again.") for i in range(90)]
    texts += [(f"l{k}", f"{GERMAN} {i}") for k in range(40) for i in range(3)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    want = collections.defaultdict(collections.Counter)
    for lang, t in texts:
        want[lang].update(c for c in t if ord(c) > 127 and c != "ș")  # in 90 of 16,090 texts: rare
    models = fitted(docs)
    assert {lang: counts for lang, (_, counts) in models.items()} == want
    assert {lang: k.rare for lang, k in statistics(docs).items()}["en"] == {"ș"}
    assert Examiner(models).text(sloppy(GERMAN), "l39")[1] == GERMAN


def test_dictionaries_are_trained_on_all_texts(spark):
    """Long and short texts, rows beyond any sample, the languages beyond the most frequent: all are in the dictionaries."""
    long, short, late = "lighthouse keepers count gulls", "tide tables at noon", "quartz veins under granite"
    texts = [("long", f"{long} {i}; " * 600) for i in range(20)] + [("short", f"{short} {i}") for i in range(300)]
    # one text in ten, so it is worth its place whichever texts a sample would take
    texts += [("many", f"row {i} says {late if i % 10 == 0 else 'nothing new today'}") for i in range(7000)]
    texts += [(f"l{k}", f"The layout of view {i} in {k} is not covered.") for k in range(40) for i in range(400)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    models = fitted(docs)
    assert {lang for lang, (data, _) in models.items() if data} == {lang for lang, _ in texts}
    for lang, phrase in (("long", long), ("short", short), ("many", late)):
        assert phrase.encode() in models[lang][0], lang
    # neither the order of the rows nor their partitions matter
    assert fitted(docs.orderBy(F.desc("doc_id")).repartition(7)) == models


def test_dictionaries_of_parts_are_merged(spark):
    phrases = ["lighthouse keepers count gulls", "tide tables at noon", "quartz veins under granite", "pupils fold maps of Zürich"]
    rows = [(i, f"{phrases[i % 4]} {i * 7919 % 100_003}", "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    size = sum(len(t) for _, t, _ in rows)
    whole, parted = fitted(docs), fitted(docs, size // 40)  # 41 parts, more than are merged at once
    assert whole["en"][1] == parted["en"][1] and set(whole) == set(parted) == {"en"}
    # the words of each phrase, in the page of the language
    for word in (w for p in phrases for w in p.split() if len(w) > 5):
        data = Page(whole["en"][1]).encode(word)
        assert data in whole["en"][0] and data in parted["en"][0], word
    assert fitted(docs.repartition(5), size // 40) == parted
