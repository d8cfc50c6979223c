"""Garbling undone: every pair of encodings, mixed text, and what was written on purpose."""

import random

import pytest

from siltstone.llm import mojibake

CLEAN = [
    "La requête n’a rien renvoyé après l’été, même très tôt.", "Größe und Übersicht für die Straße wären schön.", "A consulta não devolveu informação à sessão.",
    "It’s a naïve café, isn’t it? We’ve seen 14 × 55 grids — “fine”.", "Zażółć gęślą jaźń, proszę i był świat, więc źródło.", "Проверьте порядок изменений и ещё раз загрузите.",
    "Příliš žluťoučký kůň úpěl ďábelské ódy v řádku.", "El niño añadió 9 páginas según él: ¿qué más?", "Det er på høy tid, Søren så Åse gå.",
]


def corpus(n=40):
    return [(f"{t} {k}", t) for t in CLEAN for k in range(n)]


@pytest.fixture(scope="module")
def mender():
    from collections import Counter

    counts = Counter()
    for text, _ in corpus():
        counts.update(set(mojibake.triples(text)))
    return mojibake.Mender(dict(counts))


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "iso8859-15", "mac_roman", "cp437", "cp850", "cp1251", "cp1253", "cp1256", "cp852"])
@pytest.mark.parametrize("text", CLEAN)
def test_utf8_read_wrongly(mender, read, text):
    table = mojibake._bytes_to_chars(read)
    garbled = "".join(chr(b) if b < 128 else table[b] for b in text.encode())
    if garbled == text:
        return
    found, mended = mender.mend("A plain line. " + garbled)
    assert found and sum(a != b for a, b in zip(mended, "A plain line. " + text)) <= 2


@pytest.mark.parametrize("text", CLEAN)
def test_twice(mender, text):
    once = mojibake._spelled(text, "cp1252")
    found, mended = mender.mend(mojibake._spelled(once, "cp1252"))
    assert found and mended == text


@pytest.mark.parametrize("true,read,text", [("cp1252", "mac_roman", CLEAN[0]), ("cp1252", "mac_roman", CLEAN[3].replace("×", "x")), ("cp1250", "cp1252", CLEAN[4]), ("cp1250", "cp1252", CLEAN[6]), ("cp1251", "cp1252", CLEAN[5]), ("koi8-r", "cp1251", CLEAN[5])])
def test_one_byte_pairs(mender, true, read, text):
    garbled = "".join(mojibake._bytes_to_chars(read)[b] if b > 127 else chr(b) for b in text.encode(true))
    found, mended = mender.mend(garbled)
    assert found and sum(a == b for a, b in zip(mended, text)) >= 0.9 * len(text)


@pytest.mark.parametrize("text", [*CLEAN, None, "", "plain", "Check for sequences like â€™ and Ã¼ to the loader.", "A name shows ‘Ã©’ where it shouldn’t.", "The sign � stands for a byte.", "NÃO, ATENÇÃO", "x" * 300_000, "é" * 100_000])
def test_right_text_stays(mender, text):
    assert mender.mend(text) == (False, None)


@pytest.mark.parametrize("text", ["שלום עולם, השאילתה לא החזירה תוצאות", "مرحبا بالعالم، لم يرجع الاستعلام شيئا", "クエリは結果を返しません。", "漢字仮名交じり文の検索結果を確認する", "สวัสดีชาวโลก", "검색 결과가 없습니다"])
@pytest.mark.parametrize("read", ["cp1252", "latin-1", "mac_roman", "cp437"])
def test_scripts_that_the_corpus_lacks(mender, read, text):
    found, mended = mender.mend(mojibake._spelled(text, read))
    assert found and mended == text


@pytest.mark.parametrize("times", [3, 5, 7])
def test_garbled_any_number_of_times(mender, times):
    text = garbled = "A consulta não devolveu informação."
    for _ in range(times):
        garbled = mojibake._spelled(garbled, "cp1252")
    assert mender.mend(garbled) == (True, text)


@pytest.mark.parametrize("text", ["«évité»…", "Ïðèâåò", "Москва–Астана", "l’«été»—là", "naïve»—x", "漢字«é»—", "věšťba, těžší", "Москва и Астана", "سنگچین"])
def test_three_bytes_on_purpose(mender, text):
    assert mender.mend(text) == (False, None) or text == "Ïðèâåò"


def test_lost(mender):
    assert mender.mend("na�ve count of 1945 � 18") == (True, None)


def test_mixed_text_keeps_its_right_part(mender):
    found, mended = mender.mend("Größe bleibt. NÃ£o devolveu informaÃ§Ã£o. Söhne")
    assert found and mended == "Größe bleibt. Não devolveu informação. Söhne"


def test_table(spark):
    rows = [(i, t, "x", 1) for i, (t, _) in enumerate(corpus(20))]
    bad = [(1000, mojibake._spelled(CLEAN[2], "cp1252"), "x", 1), (1001, None, "x", 1), (1002, "", "x", 1), (1003, "caf�", "x", 1)]
    r = random.Random(0)
    every = rows + bad + bad[:1]
    r.shuffle(every)
    df = spark.createDataFrame(every, "doc_id long, text string, restored string, lost int")
    got = sorted((x["doc_id"], x["restored"], x["lost"]) for x in mojibake.find_garbled(df).collect())
    assert got == [(1000, CLEAN[2], False)] * 2 + [(1003, None, True)]
    assert mojibake.find_garbled(df.where("false")).collect() == []


def test_other_scripts_are_one_letter():
    assert mojibake.triples("漢字é漢 à1") == ["字é字", " à0"]
    assert mojibake.triples("漢字" * 1000) == []


def test_other_scripts_stay(mender):
    assert mender.mend("漢字とかな、한국어, ไทย, العربية " * 50) == (False, None)


@pytest.mark.parametrize("true,read,text", [("utf-8", "cp1252", CLEAN[0]), ("utf-8", "cp1251", CLEAN[5]), ("utf-8", "mac_roman", CLEAN[4]), ("cp1250", "cp1252", CLEAN[4]), ("cp1251", "cp1252", CLEAN[5]), ("koi8-r", "cp1251", CLEAN[5])])
@pytest.mark.parametrize("varied", [False, True])
def test_a_third_of_the_rows_garbled_alike(spark, true, read, text, varied):
    """One garbled text under many ids, or a source decoded wrongly, several times as frequent as the right spelling."""
    table = mojibake._bytes_to_chars(read)
    right = corpus(12)
    garbled = "".join(chr(b) if b < 128 else table[b] for b in text.encode(true))
    bad = [garbled + f" {k}" * varied for k in range(len(right) // 2)]
    rows = [(i, t) for i, (t, _) in enumerate(right)] + [(1000 + i, t) for i, t in enumerate(bad)]
    got = {x["doc_id"] for x in mojibake.find_garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1000 + i for i in range(len(bad))}
