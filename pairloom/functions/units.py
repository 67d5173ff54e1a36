"""Numbers with units and dimensions in texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings, as words in natural order.
UNITS = """
мм м см дм км нм мкм дюйм сантиметр миллиметр километр нанометр km мм² см² дм² м² км² м³ см³ мм³
г кг мг т kg g грамм килограмм миллиграмм mg л мл литр миллилитр ml
гб гбит мб мбит кб кбит тб тбит байт бит гигабайт гигабит мегабайт gb kb mb
час ч мин сек с минут секунд min sec h
в квт мвт вт ва ква мва а ма ка мка вольт ампер ампер-час ач мач ватт mah w ом ohm Ω mΩ ф мкф нф пф
гц кгц мгц ггц герц килогерц мегагерц гигагерц hz khz mhz ghz дб децибел db бар паскаль па гпа кпа атм
градус ° рад радиан °c °f град цельсий фаренгейт процент % шт ед штук дж кдж ккал моль н кн
лс об/мин км/ч м/с m/h km/h kmh км/с мм/с миль/ч г/см3 кг/м3 люмен дптр
пиксель пикс px dpi ppi кадр/с fps flops gflops tflops mips ipc $ € £ ¥ руб. р. rub usd eur
ядро ядер поток потоков thread core операций/с op/s дюймов inch mp мп mpx мегапиксель мегапикселей
""".split() + ["лошадиных сил", "куб.см", "куб.м"]  # fmt: skip

_ALT = "|".join(re.escape(u) for u in sorted(UNITS, key=lambda u: (-len(u), u)))
# a unit ends at a word boundary: a letter or digit before it and none behind, or the other way round
_UNIT = rf"(?iu)([0-9]+(?:[.,][0-9]+)?)\s?({_ALT})(?:(?<=[\p{{L}}\p{{N}}_])(?![\p{{L}}\p{{N}}_])|(?<![\p{{L}}\p{{N}}_])(?=[\p{{L}}\p{{N}}_]))"
_DIM = r"([0-9]+)\s*[xх*]\s*([0-9]+)(?:\s*[xх*]\s*([0-9]+))?"


def find_units(c: Column) -> Column:
    """Distinct ``"number unit"`` and ``AxB`` or ``AxBxC`` strings, sorted; none for null."""
    c = F.coalesce(c, F.lit(""))
    nums, units = F.regexp_extract_all(c, F.lit(_UNIT), F.lit(1)), F.regexp_extract_all(c, F.lit(_UNIT), F.lit(2))
    measures = F.zip_with(nums, units, lambda n, u: F.concat(n, F.lit(" "), u))
    sides = [F.regexp_extract_all(c, F.lit(_DIM), F.lit(k)) for k in (1, 2, 3)]
    dims = F.transform(F.arrays_zip(*[s.alias(f"s{i}") for i, s in enumerate(sides)]), lambda e: F.concat_ws("x", e["s0"], e["s1"], F.nullif(e["s2"], F.lit(""))))
    return F.array_sort(F.array_distinct(F.concat(measures, dims)))
