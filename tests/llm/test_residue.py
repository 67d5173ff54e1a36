import pytest

from pairloom.llm import residue as R

BAD = {
    "error": ["Главная | Каталог | Войти<br>Error 429: доступ к разделу закрыт<br>Try again", "Страница не найдена", "Упс! такой страницы больше нет", "503 сессия устарела, войдите снова", "Обычный текст о столе.\nAccess to this page is denied\nЕщё текст."],
    "script": ["Для работы сайта включите JavaScript", "This application requires scripts to be enabled", "Подождите, проверяем браузер — To view this page необходим JavaScript"],
    "request": ["TODO: Add your описание товара", "[Здесь будет заголовок]", "*** Insert описание товара ***", "Replace this with headline!"],
    "slot": ["{{ price }} — {{ title }} руб.", "Куплено [[city]] магазине", "Состояние: &lt;DATE&gt;", "Вес {ИМЯ} кг", "Продаю ${model}", "%city% и %qty%", "__SHOP_URL__", "стоит #brand# рублей", "Selling <%= brand %> now", "цвет [товар]"],
    "null": ["Название: null. Бренд: undefined. Цена: null ₽.", "Item NaN by null — NaN USD", "[object Object], цена [object Object] руб.", "null | null | nullОтправлю"],
    "filler": ["текст текст текст текст", "asdf\nasdf\nasdf", "..... ..... ..... .....", "Lorem ipsum dolor sit amet", "название товара, название товара, название товара"],
}
GOOD = [
    "Футболка с принтом «504 внутренняя ошибка приложения», размер 48",
    "Продаю шаблоны писем для магазинов: поля {имя} и {город} подставляются сами",
    "Полка [80х15] и полка [60х13], крепёж есть",
    "Плакат в рамке: «{ и }», подарок знакомому верстальщику",
    "Обучаю JavaScript с нуля, 2 занятия",
    "Кружка программиста с надписью undefined, объём 330 мл",
    "Чиню стиральные машины: ошибка 502, ошибка E17, не греет",
    "Скидка 71% на всё, а 37% на остальное",
    "Наклейки «Загрузка…» на ноутбук", "торг", "Продано", "sold", "<b>Стол</b><br>белый", "Цена 100 рублей. Цена 100 рублей.", "",
]


@pytest.mark.parametrize("kind", list(BAD))
def test_kinds(spark, kind):
    docs = [(i, t, "error") for i, t in enumerate(BAD[kind])] + [(100 + i, t, "x") for i, t in enumerate(GOOD)] + [(500, None, "x"), (0, BAD[kind][0], "x"), (501, "слово о деле " * 40_000 + ". Стол белый.", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["kinds"] for r in R.residue(df).collect() if r["doc_id"] != 501}
    assert set(got) == set(range(len(BAD[kind])))
    assert all(kind in k for k in got.values())


def test_rest_of_the_corpus(spark):
    df = spark.createDataFrame([(1, "Стол белый, крепкий"), (2, "Страница не найдена"), (1, "Стол белый, крепкий"), (3, None)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in R.without_residue(df).collect()) == [1, 1, 3]
    assert R.residue(df.where("doc_id > 9")).collect() == []


def test_templates_of_a_corpus(spark):
    """Leaves of the prefix tree: numbers masked, at each further place the word that all messages share."""
    texts = [f"Заряда или топлива хватает на {i} часов, проверяли {w} снова" for i, w in enumerate(["дома", "дома", "дома", "весной"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = R.templates(R.scan(df, "doc_id", "text", everything=True)).collect()
    assert [(r["n_messages"], r["template"]) for r in rows] == [(4, "заряда или топлива хватает на <*> часов проверяли <*> снова".split())]


def test_pruning_never_loses_a_verdict():
    for texts in BAD.values():
        for t in texts:
            for m in R.messages(t):
                code, k = R.coded(m, R.masked(m))
                assert code or R.may_match(k) or R.verdict(k) is None


def test_unknown_message_is_learnt_from_its_status_codes(spark):
    """A template that stands behind two different status codes is an error message wherever it stands."""
    docs = ["Ошибка 503: кот перегрыз провод", "Сбой 404: кот перегрыз провод", "кот перегрыз провод", "Кот перегрыз провод, продаю дёшево", "Ошибка 404: пёс съел кость", "пёс съел кость"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r["doc_id"] for r in R.residue(df).collect()} == {0, 1, 2, 4}


@pytest.mark.parametrize("slot", "{{x_1}} {{{name}}} {%price%} <%=a.b%> [[город]] <<title>> ${sum} #{sum} @@DATE@@ %%qty%% __CITY__ ##имя## @{name} <model>".split())
def test_slots_by_form(slot):
    assert R.has_slot(f"Цена {slot}, торг") and R.has_slot(slot)
    assert not R.has_slot(f"Продаю шаблоны писем, поле {slot} меняется")


@pytest.mark.parametrize("text", ["<b>Стол</b>", "#sale #new", "скидка 5% на всё, 10% на два", "**новый** товар", "a < b и c > d", "C# и F# книги", "mail@x.ru и y@z.ru", "«{ и }»", "R&D и Q&A", "5 > x < 7"])
def test_signs_as_content(text):
    assert not any(map(R.has_slot, R.messages(text)))


def test_filler_of_any_vocabulary(spark):
    """Words recombined evenly are filler, and so is a short piece of the same words; sentence forms are not."""
    import random

    rng = random.Random(3)
    words = "бурлак тирмон зелвик совдур маркуш пентол грумиз хоранд видлус ремтап".split()
    say = lambda n: (" ".join(rng.choice(words) for _ in range(n)) + ".").capitalize()
    full = [" ".join(say(rng.randint(6, 10)) for _ in range(3)) for _ in range(6)]
    piece = "Продаю стол, торг уместен. " + " ".join(words[:5]).capitalize() + ". Звоните до шести."
    forms = ". ".join(f"Если {a} покажется слишком {b}, можно поставить другой" for a, b in zip("экран рычаг клапан корпус кулер".split(), "тихий плотный гладкий узкий яркий".split()))
    colours = ". ".join(f"Цвет {a}, {b} тоже {c}" for a, b, c in (("синий", "насос", "белый"), ("белый", "провод", "синий"), ("чёрный", "корпус", "белый"), ("синий", "замок", "чёрный")))
    docs = [*full, piece, forms, colours, "Стол письменный дубовый крепкий светлый"]
    got = {r["doc_id"] for r in R.residue(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == set(range(7))
