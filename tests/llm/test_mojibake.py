"""Wrong encodings: round trips, clean texts and defined cases."""

import pytest

from shelfmark.llm.mojibake import affected, repair, repair_by, repaired
from tests.llm.fixtures import documents

FRENCH = "L’équipe éditrice a reçu « 241 atlas » consacrés à l’œnologie, près de la forêt."
SPANISH = "¡Atención! ¿Por qué la Asociación no acepta resúmenes de ingeniería? Según el año."
GERMAN = "„Lärmschutz braucht Öffentlichkeit“, schrieb die Geschäftsstelle über größere Bögen."
POLISH = "Dział „pielęgniarstwa” prowadzi spółka wydawnicza; żaden z 20 tekstów nie dotyczył źródeł."
RUSSIAN = "Редакционная коллегия отклонила 14 материалов, не связанных с темой «языкознание». Объём: обзоры не превышают 6 слов."
CHINESE = "论坛用户询问：为什么编辑委员会不接受农村卫生方面的书评？自2018年起，学会秘书处优先审阅书评。"


def garble(text, right, wrong):
    raw = text.encode(right)
    out = ""
    for b in raw:
        try:
            out += bytes([b]).decode(wrong)
        except UnicodeDecodeError:
            out += chr(b)
    return out


@pytest.mark.parametrize("text", [FRENCH, SPANISH, GERMAN, POLISH, RUSSIAN, CHINESE])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "cp1250", "cp1251", "cp437", "mac_roman"])
def test_utf8_round_trip(text, wrong):
    fixed, spans, hit = repair(garble(text, "utf-8", wrong))
    assert hit and spans and fixed == text


OTHER_SCRIPTS = [
    "Great news 😀🎉 for all readers 👍🏽", "Tạp chí Khoa học và Công nghệ, số đặc biệt về giáo dục", "المجلة العربية للعلوم الإنسانية",
    "כתב עת לחקר ההיסטוריה", "한국어 학술지의 새로운 논문", "วารสารวิชาการภาษาไทย", "हिन्दी की शोध पत्रिका", "ქართული ჟურნალი", "Հայերեն հանդես",
]


@pytest.mark.parametrize("text", OTHER_SCRIPTS)
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
def test_other_scripts(text, wrong):
    assert repair(text) == (text, 0, False)
    fixed, spans, hit = repair("Note: " + garble(text, "utf-8", wrong) + " (2019)")
    assert hit and spans and fixed == "Note: " + text + " (2019)"


def test_readings_are_named():
    assert repair_by(garble(FRENCH, "utf-8", "cp1252"))[3] == ["utf8"]
    assert repair_by(garble(garble(FRENCH, "utf-8", "cp1252"), "utf-8", "cp1252"))[3] == ["utf8", "utf8"]
    assert repair_by(garble(POLISH, "cp1250", "latin-1"))[3] == ["polish"] and repair_by("lost � here")[3] == ["lost"]
    deep = FRENCH
    for _ in range(10):
        deep = garble(deep, "utf-8", "latin-1")
    assert repair_by(deep)[0] == FRENCH


@pytest.mark.parametrize("text", [FRENCH, SPANISH, GERMAN])
def test_garbled_twice(text):
    assert repair(garble(garble(text, "utf-8", "cp1252"), "utf-8", "cp1252"))[0] == text


@pytest.mark.parametrize(("right", "wrong"), [("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1251", "latin-1"), ("cp1251", "cp1252")])
def test_russian_between_single_byte_sets(right, wrong):
    text = RUSSIAN.replace("«", '"').replace("»", '"')
    assert repair(garble(text, right, wrong))[0] == text


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
def test_polish_code_page(wrong):
    assert repair(garble(POLISH, "cp1250", wrong))[0] == POLISH


def test_chinese_between_two_byte_sets():
    as_gbk = CHINESE.encode("utf-8").decode("gb18030", "replace")
    assert repair(as_gbk)[2] and "论坛用户询问" in repair(as_gbk)[0]
    as_latin = CHINESE.encode("gbk").decode("latin-1")
    assert repair(as_latin)[0].startswith("论坛用户询问：为什么")
    as_big5 = CHINESE.encode("gbk").decode("big5hkscs", "replace")
    assert repair(as_big5)[2] and "农村卫生" in repair(as_big5)[0]


def test_only_garbled_places_change():
    text = "ATENÇÃO À REDAÇÃO: a comissão " + garble("não aceita", "utf-8", "cp1252") + " «É»."
    assert repair(text)[0] == "ATENÇÃO À REDAÇÃO: a comissão não aceita «É»."


CLEAN = [
    FRENCH, SPANISH, GERMAN, POLISH, RUSSIAN, CHINESE, "", "plain", "ATENÇÃO À REDAÇÃO: SEÇÃO DE 1981, AÇÕES", "48 ± 262 µm³, 20 °C, km²",
    "The Ørsted–Nefokume index; Ångström; jalapeño; café”", "«СССР» Рё… ОБЪЯВЛЕНИЕ ДЛЯ АВТОРОВ", "D’APRÈS LA NOTE 195", "《期刊》（测试）",
    "Plzeňští měšťané, těšťanka, Ještě žížaly", "«МАРШ» и «БОРЩ»; ПЛАЩ… в…» НОЧ“ ЛУЧ»", "Ø 5 ± 2 µm, Ù, 3 × 4", "“À” «Ò»", "Đường sắt Việt Nam", "żółć, gęś, źdźbło",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert repair(text) == (text, 0, False)


def test_lost_characters_count(spark):
    d = documents(spark, [(1, "lost � here"), (2, None), (3, ""), (4, "dÃ©jÃ  vu"), (4, "dÃ©jÃ  vu"), (5, "é" * 200_000), (6, "Ã©" * 100_000)])
    assert {r.doc_id for r in affected(d).collect()} == {1, 4, 6}
    rows = {r.doc_id: r for r in repaired(d).collect()}
    assert not rows[1].complete and rows[6].restored == "é" * 100_000 and rows[6].spans == 1


def test_empty_table(spark):
    assert affected(documents(spark, [])).count() == 0
